"""Licence scan by Aho-Corasick and licence expressions (operator 13).

Two automata read each whole text once. The first goes over the text's
*words* (ASCII letters in lower case, digits and all beyond ASCII; joined by
one space), so a notice phrase is found where its words stand consecutively
whatever stands between them. The second goes over the lower-cased text as
it is and finds identifier tags (``SPDX-License-Identifier:`` and others);
what follows a tag on its line is cut into identifiers, parentheses and the
words ``and``, ``or``, ``with``, put into postfix order by the shunting-yard
algorithm (``with`` binds closest, then ``and``, then ``or``) and evaluated:

* an identifier gives its label and its restriction, a number from 0 (free)
  to 1 (all rights reserved); an unknown one gives no label and ``UNKNOWN``;
* ``or`` offers a choice: the least restriction of the two;
* ``and`` binds to both: the greater one;
* ``with`` adds an exception: half the restriction of the licence.

A malformed expression is evaluated as far as it goes: operators without
operands and parentheses without partner are skipped.

``score`` is the greatest restriction of a text's phrases and expressions, 0
where there are none.

One narrow pass, no shuffle, nothing for the driver.

Defined cases: a null or empty text has no words, matches or labels and a
score of 0; texts are read whole; repeated rows give a result each; columns
of the input named like a result column (``n_words``, ``matches``,
``expressions``, ``labels``, ``score``) are replaced, others pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabflow.llm.common import prepare, text_bytes

#: Phrases that the contract of the query names, with their labels (fixed values).
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, in words.
PHRASES = {
    "mit license": "mit",
    "the mit licence": "mit",
    "apache license 2 0": "apache-2",
    "apache 2 0 license": "apache-2",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "licensed under cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "reserved",
    "for non commercial use only": "non-commercial",
}
#: Tags that a licence expression follows, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Identifiers of expressions by their beginning, longest first; a version may follow.
IDENTIFIERS = {
    "cc-by-nc-sa": "cc-by-nc-sa",
    "cc-by-nc-nd": "cc-by-nc-nd",
    "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
    "cc-by": "cc-by",
    "cc0": "cc0",
    "apache-2": "apache-2",
    "mit": "mit",
    "isc": "isc",
    "bsd": "bsd",
    "mpl": "mpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "gpl": "gpl",
    "unlicense": "cc0",
    "proprietary": "reserved",
}
#: How far a licence restricts use, 0 to 1.
RESTRICTION = {
    "cc0": 0.0,
    "mit": 0.1,
    "isc": 0.1,
    "bsd": 0.1,
    "apache-2": 0.15,
    "cc-by": 0.2,
    "mpl": 0.35,
    "lgpl": 0.4,
    "cc-by-sa": 0.45,
    "gpl": 0.6,
    "agpl": 0.7,
    "cc-by-nd": 0.75,
    "cc-by-nc": 0.8,
    "cc-by-nc-sa": 0.85,
    "cc-by-nc-nd": 0.9,
    "non-commercial": 0.8,
    "reserved": 1.0,
}
UNKNOWN = 0.5

#: Operators of expressions and how closely they bind.
BINDS = {"or": 1, "and": 2, "with": 3}

#: Bytes of words in lower case; all others become spaces.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
#: Letters, digits, hyphens and underscores before a tag make it part of a longer word.
_INNER = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789-_")


@functools.lru_cache(maxsize=1)
def _automata():
    """The automaton of phrases (over spaced words) and that of tags."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**PHRASES, **BASE_PHRASES}.items():
        phrases.add_word(f" {phrase} ", (phrase, label, len(phrase) + 2))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def phrase_places(words: list[bytes]) -> list[tuple[int, str, str]]:
    """(first word, phrase, label) of every place, by place and phrase."""
    spaced = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = []
    seen = at = 0
    for end, (phrase, label, size) in _automata()[0].iter(spaced):
        start = end + 1 - size
        if start >= at:
            seen += spaced.count(" ", at, start)
            at = start
            first = seen
        else:
            first = seen - spaced.count(" ", start, at)
        found.append((first, phrase, label))
    return sorted(found)


def tokens_of(text: bytes, start: int = 0, end: int | None = None) -> list[str]:
    """Identifiers, parentheses and operators of the expression that ``text[start:end]`` begins with.

    An expression ends where two operands meet: what follows is other text.
    """
    out: list[str] = []
    operand = False  # whether the last token ends an operand
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        token = m[0].decode()
        if token in BINDS or token == ")":
            operand = token == ")"
        elif operand:
            break
        else:
            operand = token != "("
        out.append(token)
    return out


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: operands and operators in postfix order; stray parentheses vanish."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        else:
            out.append(token)
    return out + [t for t in reversed(held) if t != "("]


def label_of(identifier: str) -> str | None:
    for start, label in IDENTIFIERS.items():
        if identifier.startswith(start) and not identifier[len(start) : len(start) + 1].isalpha():
            return label
    return None


def evaluate(tokens: list[str]) -> tuple[list[str], float] | None:
    """Labels and restriction of an expression; None where it names no licence."""
    held: list[tuple[frozenset, float]] = []
    for token in postfix(tokens):
        if token not in BINDS:
            label = label_of(token)
            held.append((frozenset([label] if label else []), RESTRICTION[label] if label else UNKNOWN))
            continue
        if len(held) < 2:
            continue  # an operand is missing
        (right, strict_right), (left, strict_left) = held.pop(), held.pop()
        if token == "with":  # an exception is no licence
            held.append((left, strict_left / 2))
        elif token == "and":
            held.append((left | right, max(strict_left, strict_right)))
        else:
            held.append((left | right, min(strict_left, strict_right)))
    if not held:
        return None
    labels = frozenset().union(*[x for x, _ in held])
    return (sorted(labels), max(r for _, r in held)) if labels else None


def expressions_of(text: bytes) -> list[tuple[str, list[str], float]]:
    """(expression, labels, restriction) of every tag whose line names a known licence."""
    low = text.translate(_LOWER)
    out = []
    line_end = -1
    for end, size in _automata()[1].iter(low.decode("latin-1")):
        start = end + 1 - size
        if start and low[start - 1] in _INNER:
            continue
        if line_end < end:
            line_end = low.find(b"\n", end)
            line_end = len(low) if line_end < 0 else line_end
        tokens = tokens_of(low, end + 1, line_end)
        value = evaluate(tokens)
        if value:
            out.append((" ".join(tokens), *value))
    return out


MATCH = T.StructType(
    [
        T.StructField("word", T.LongType(), False),
        T.StructField("phrase", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
    ]
)
EXPRESSION = T.StructType(
    [
        T.StructField("expression", T.StringType(), False),
        T.StructField("labels", T.ArrayType(T.StringType(), False), False),
        T.StructField("restriction", T.DoubleType(), False),
    ]
)
_ARROW = {
    "n_words": pa.int64(),
    "matches": pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])),
    "expressions": pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("restriction", pa.float64())])),
    "labels": pa.list_(pa.string()),
    "score": pa.float64(),
}


def scan(text: bytes) -> dict:
    """Results of one text, by name of the result column."""
    words = words_of(text)
    places = phrase_places(words)
    found = expressions_of(text)
    labels = {label for _, _, label in places}.union(*[x for _, x, _ in found])
    score = max([0.0, *(RESTRICTION[label] for _, _, label in places), *(r for _, _, r in found)])
    return {
        "n_words": len(words),
        "matches": [{"word": w, "phrase": p, "label": x} for w, p, x in places],
        "expressions": [{"expression": e, "labels": x, "restriction": r} for e, x, r in found],
        "labels": sorted(labels),
        "score": score,
    }


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, phrase ``matches``, tagged ``expressions``, ``labels`` and ``score`` of ``text``."""
    prepare(docs.sparkSession)
    made = list(_ARROW)
    docs = docs.drop(*[c for c in made if c != text])
    schema = T.StructType(
        docs.schema.fields
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("matches", T.ArrayType(MATCH, False)),
            T.StructField("expressions", T.ArrayType(EXPRESSION, False)),
            T.StructField("labels", T.ArrayType(T.StringType(), False)),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in text_bytes(batch.column(text))]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in _ARROW.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, expressions and score of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("matches", lambda m: m["phrase"].isin(*BASE_PHRASES))
    at = F.transform(base, lambda m: m["word"])
    return license_scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
