"""Rows and helpers that the tests of the corpus operators share."""

import duckdb
import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

LONG = "many words " * 9_000 + "end"
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\v\f "),
    (4, "one two"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line of it.\nA third.\n\nA fourth."),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line of it.\nA third.\n\nA fourth."),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line of it.\nA third.\nAnother end, with  spaces\t."),
    (8, "café naïve İstanbul ΣΑΣ é ﬁ 你好 \U0001f600 don't I'll 12345 3.14 #*$%&|<>"),
    (9, "a <|endoftext|> b<|endoftext|>c <|startoftext|>     x  y   z \n\n  tail "),
    (10, LONG),
    (11, LONG),
    (12, "x" * 70_000),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line of it.\nA third.\n\nA fourth."),
    (None, "a text without an id but with quite enough words to pass all the rules there are"),
    (None, None),
]
#: Columns that are named like results or helpers of the operators.
CLASHES = ["kept", "n_tokens", "ids", "class_id", "row", "block", "slot", "runs", "n_words", "score", "spans", "symbols", "fixed", "copies"]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "src" if k % 3 else None, "en") for k, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"old {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(path=SF):
    return duckdb.execute(f"SELECT doc_id, text, source FROM '{path}/documents.parquet' ORDER BY doc_id").fetchall()


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]
