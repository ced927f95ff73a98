"""Licence scan against brute force, and the expression parser."""

import random
import re

import pytest
from corpus_cases import SF, empty, messy, plain

from cabflow.llm.licenses import (
    BASE_PHRASES,
    PHRASES,
    RESTRICTION,
    UNKNOWN,
    evaluate,
    expressions_of,
    license_scan,
    op13_license_scan,
    phrase_places,
    postfix,
    tokens_of,
    words_of,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def naive_places(words, phrases):
    out = []
    for phrase, label in phrases.items():
        want = phrase.split()
        out += [(i, phrase, label) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
    return sorted(out)


def test_phrases_in_random_words():
    r = random.Random(3)
    pool = sorted({w for p in (*BASE_PHRASES, *PHRASES) for w in p.split()})
    for _ in range(300):
        words = [r.choice(pool) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice([*BASE_PHRASES, *PHRASES]).split()
        text = "".join(w.title() + r.choice([" ", ", ", "-\n", "_(", "é "]) for w in words)
        found = words_of(text.encode())
        assert [w.decode() for w in found] == naive_words(text)
        want = naive_places(naive_words(text), {**PHRASES, **BASE_PHRASES})
        assert phrase_places(found) == want


@pytest.mark.parametrize(
    "line, labels, restriction",
    [
        ("MIT", ["mit"], 0.1),
        ("MIT OR GPL-3.0-only", ["gpl", "mit"], 0.1),
        ("MIT AND GPL-3.0-only", ["gpl", "mit"], 0.6),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["gpl"], 0.3),
        ("MIT AND GPL-2.0 WITH Classpath-exception-2.0 OR CC0-1.0", ["cc0", "gpl", "mit"], 0.0),
        ("(MIT OR Apache-2.0) AND CC-BY-NC-4.0", ["apache-2", "cc-by-nc", "mit"], 0.8),
        ("MIT OR Apache-2.0 AND CC-BY-NC-4.0", ["apache-2", "cc-by-nc", "mit"], 0.1),
        ("mit and something-else", ["mit"], UNKNOWN),
        ("mit. The rest of the line", ["mit"], 0.1),
        ("((mit or", ["mit"], 0.1),
        (") and mit )", ["mit"], 0.1),
        ("mitigated", None, None),
        ("and or with", None, None),
        ("", None, None),
    ],
)
def test_expressions(line, labels, restriction):
    want = None if labels is None else (labels, restriction)
    assert evaluate(tokens_of(line.lower().encode())) == want
    found = expressions_of(f"// SPDX-License-Identifier: {line}\nmit".encode())
    assert [(x, r) for _, x, r in found] == ([want] if want else [])


def test_postfix_of_random_expressions():
    """Against Python's own precedence: with > and > or, as * > + > |."""
    r = random.Random(5)
    names = ["mit", "gpl", "cc0", "agpl"]
    value = dict(zip(names, (RESTRICTION[n] for n in names)))

    class V:
        def __init__(self, x):
            self.x = x

        __or__ = lambda a, b: V(min(a.x, b.x))
        __add__ = lambda a, b: V(max(a.x, b.x))
        __mul__ = lambda a, b: V(a.x / 2)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(names)
        op = r.choice(["and", "or", "with"])
        left, right = made(depth - 1), made(depth - 1)
        return f"( {left} ) {op} ( {right} )" if r.random() < 0.5 else f"{left} {op} {right}"

    for _ in range(300):
        tokens = made(4).split()
        code = " ".join({"and": "+", "or": "|", "with": "*"}.get(t, f"V({value[t]})" if t in value else t) for t in tokens)
        assert evaluate(tokens)[1] == eval(code, {"V": V}).x
        assert sorted(t for t in postfix(tokens)) == sorted(t for t in tokens if t not in "()")


def test_tags_inside_words_do_not_count():
    assert expressions_of(b"sublicense: mit") == []
    assert [e for e, _, _ in expressions_of(b"License: MIT license: gpl\nLICENCE:isc")] == ["mit", "gpl", "isc"]


def test_query_on_documents(spark):
    want = {}
    for i, text, _ in plain():
        words = naive_words(text)
        places = naive_places(words, BASE_PHRASES)
        at = [p[0] for p in places]
        want[i] = (i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({p[2] for p in places})))
    rows = op13_license_scan(spark, SF).collect()
    assert {r.doc_id: tuple(r)[:6] for r in rows} == want and len(rows) == len(plain())
    assert any(r.n_base for r in rows)
    for r in rows:
        labels = [x for x in r.labels.split(",") if x]
        assert set(x for x in r.base_labels.split(",") if x) <= set(labels) and labels == sorted(set(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) <= bool(labels)


def test_messy_and_no_rows(spark, messy, empty):
    found = license_scan(messy)
    rows = found.collect()
    assert len(rows) == messy.count() and all(r.kept == "old kept" for r in rows)
    assert found.columns == [c for c in messy.columns if c not in ("n_words", "score")] + ["n_words", "matches", "expressions", "labels", "score"]
    for r in rows:
        assert r.n_words == len(naive_words(r.text)) and r.labels == [] and r.score == 0
    assert license_scan(empty).count() == 0
