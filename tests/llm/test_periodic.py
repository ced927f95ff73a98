"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from corpus_cases import SF, empty, messy, plain

from cabflow.llm.periodic import collapse, find_runs, op11_periodic_runs, periodic_runs, run_digests


def naive_runs(words, shortest=12):
    """Every stretch of each period that cannot be extended; the smallest period of a stretch stays."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q if j > i else 0
            if length >= max(shortest, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def naive_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = naive_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(runs),
        *best,
        best[1] and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(8):
        letters = "abcdefgh"[: r.choice([1, 2, 2, 3, 8])]
        words = []
        while len(words) < r.choice([0, 11, 12, 30, 150]):
            part = [r.choice(letters) for _ in range(r.randint(1, 9))]
            words += part * r.choice([1, 1, 2, 3, 7])
        texts.append(" ".join(words).encode())
    shortest = r.choice([2, 3, 5, 12, 13])
    assert find_runs(texts, shortest) == [naive_runs(t.split(), shortest) for t in texts]


def test_fibonacci_and_equal_words():
    a, b = ["x"], ["x", "y"]
    while len(b) < 400:
        a, b = b, b + a
    texts = [" ".join(b).encode(), b"w " * 500, b"w " * 11, b"w " * 12, b"p q " * 300 + b"p"]
    assert find_runs(texts) == [naive_runs(t.split()) for t in texts]


def test_many_words_to_the_left():
    """A passage that comes back after ever other words, and a long run among them."""
    passage = "one two three four five six seven eight"
    text = " ".join(f"w{i} {passage}" for i in range(400)) + " z" * 300 + " " + f"{passage} " * 40
    assert find_runs([text.encode()]) == [naive_runs(text.encode().split())]


def test_collapse_keeps_first_periods():
    words = b"s a b c a b c a b c a b c t".split()
    runs = naive_runs(words)
    assert runs == [(1, 12, 3)] and collapse(words, runs) == b"s a b c t"


def test_query_on_documents(spark):
    want = [naive_row(i, t) for i, t, _ in plain() if not t or len(t.split()) < 2_500]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(plain())
    assert [got[r[0]] for r in want] == want
    assert sum(r[1] > 0 for r in want) > 10


def test_messy_and_no_rows(spark, messy, empty):
    found = periodic_runs(messy.withColumn("runs", messy["runs"]))
    assert found.columns == [c for c in messy.columns if c != "runs"] + ["runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == messy.count() and all(r.kept == "old kept" for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert by_id[1].collapsed == "" == by_id[2].collapsed == by_id[3].collapsed
    assert by_id[10].runs == [(0, 18_000, 2)] and by_id[10].collapsed == "many words end"
    assert by_id[12].runs == [] and by_id[12].collapsed == "x" * 70_000
    assert run_digests(found).count() == len(rows)
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(empty, min_words=1)
