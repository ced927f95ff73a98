"""Every operator on messy rows (nulls, empty and long texts, ties, repeats, clashing columns) and on no rows."""

import pytest
from corpus_cases import BYTE_BPE, CLASHES, LONG, TEXTS, WORD_BPE, empty, messy

from cabflow.llm.bpe_codec import bpe_codec
from cabflow.llm.common import scratch_path
from cabflow.llm.embedding_dedup import embedding_dedup
from cabflow.llm.hmm import hmm_scores
from cabflow.llm.line_dedup import line_dedup
from cabflow.llm.minhash import near_duplicates
from cabflow.llm.mixing import mix_sources
from cabflow.llm.quality import quality_rules
from cabflow.llm.records import read_records, write_records
from cabflow.llm.repeats import suffix_dedup
from cabflow.llm.token_counts import token_counts

OPERATORS = {
    "quality": lambda d: quality_rules(d, clean=True),
    "mixing": mix_sources,
    "minhash": near_duplicates,
    "lines": line_dedup,
    "repeats": suffix_dedup,
    "hmm": lambda d: hmm_scores(d, rounds=1, states=2),
    "codec": lambda d: bpe_codec(d, WORD_BPE),
    "counts": lambda d: token_counts(d, BYTE_BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows(messy, name):
    out = OPERATORS[name](messy)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    assert len(rows) >= len(TEXTS) if name == "mixing" else len(rows) == len(TEXTS)
    made = set(out.columns) - set(messy.columns)
    for c in set(CLASHES) & set(out.columns) - made:
        assert out.schema[c].dataType.simpleString() != "string" or {r[c] for r in rows} == {f"old {c}"}
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[5]) >= 2 and len(by_id[None]) >= 2
    if name == "quality":
        assert [r.kept for r in by_id[1] + by_id[2] + by_id[3] + by_id[4]] == [False] * 4
        assert by_id[5][0].kept and by_id[5][0].n_words == 23 and by_id[8][0].n_symbols == 8
        assert by_id[10][0].n_repeat_words == len(LONG.split()) - 1 and not by_id[10][0].kept
    elif name == "minhash":
        assert {r.class_id for i in (5, 6) for r in by_id[i]} == {5} and {r.class_id for r in by_id[10] + by_id[11]} == {10}
        assert sorted(r.kept for i in (5, 6) for r in by_id[i]) == [False, False, True]
        assert [r.class_id for i in (1, 2, 3) for r in by_id[i]] == [1, 2, 3]  # nothing to share
    elif name == "lines":
        assert by_id[1][0].text is None and by_id[3][0].text == TEXTS[2][1]
        assert sorted(r.n_removed for i in (5, 6) for r in by_id[i]) == [0, 4, 4]
        assert by_id[7][0].text == "Another end, with  spaces\t." and by_id[7][0].n_removed == 3
    elif name == "repeats":
        assert "text" not in out.columns and by_id[1][0].n_bytes == 0 and by_id[1][0].kept == b""
        assert [bytes(r.kept) for r in by_id[6]] == [b""] and all(len(r.kept) == r.n_bytes for r in by_id[5])
        assert bytes(by_id[11][0].kept) == b"" and bytes(by_id[12][0].kept) == b"x" * 70_000
    elif name == "hmm":
        assert by_id[2][0].n_tokens == 1 and all(r.score < 0 and r.base_score < 0 for r in rows)
    elif name == "codec":
        assert by_id[1][0].ids == [] and by_id[1][0].decoded == "" and by_id[3][0].n_tokens == 0
    elif name == "counts":
        assert (by_id[1][0].n_bytes, by_id[1][0].n_tokens) == (0, 0) and by_id[10][0].over_limit


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_records_of_no_rows_and_messy_rows(spark, messy, empty):
    path = scratch_path(spark, "records")
    assert read_records(write_records(empty, BYTE_BPE, path, end_id=2), path).collect() == []
    with pytest.raises(Exception, match="doc_id is null"):
        write_records(messy, BYTE_BPE, scratch_path(spark, "records"), end_id=2)
    path = scratch_path(spark, "records")
    got = read_records(write_records(messy.where("doc_id is not null"), BYTE_BPE, path, end_id=2), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in TEXTS if i is not None)
    assert [r.ids for r in got[:2]] == [[2], [2]]


def test_embeddings_messy_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.9, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.05]), (1, [1.0, 0.0]), (11, [1e-200, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, row string, kept string")
    got = {}
    for r in embedding_dedup(vectors).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    linked = 6  # 1, 1, 2, 3, 11 and the row without an id
    for i in (1, 2, 3, 11):
        assert all(x == (linked - 1, 1, i == 1) for x in got[i]), i
    assert got[None] == [(linked - 1, 1, False)] and len(got[1]) == 2
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert got[i] == [(0, i, True)], i
    assert embedding_dedup(vectors.limit(0)).collect() == []
