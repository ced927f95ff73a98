"""Rows without a document id get records too, after all others."""

from corpus_cases import BYTE_BPE, TEXTS, messy

from cabflow.llm.common import scratch_path
from cabflow.llm.records import op8_token_records, read_records, write_records


def test_null_ids_have_records(spark, messy):
    path = scratch_path(spark, "records")
    index = write_records(messy, BYTE_BPE, path, end_id=2, shard_rows=4, null_ids=True)
    got = read_records(index, path).orderBy("start").collect()
    ids = [i for i, _ in TEXTS]
    assert [r.doc_id for r in got] == sorted(i for i in ids if i is not None) + [None] * ids.count(None)
    assert sorted(len(r.ids) > 1 for r in got[-2:]) == [False, True]  # a text and a null one
    assert [r.start for r in got] == [sum(r.n_ids for r in got[:k]) for k in range(len(got))]


def test_query_takes_null_ids(spark, messy):
    folder = scratch_path(spark, "null-ids")
    messy.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    assert op8_token_records(spark, folder).count() == len(TEXTS)
