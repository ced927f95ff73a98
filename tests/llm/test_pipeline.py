"""The pipeline, stage by stage, against brute force on the given documents."""

import duckdb
import pytest
from corpus_cases import SF, WORD_BPE, components_of, empty, messy
from test_duplicates import naive_jp, shingle_counts
from tokenizers import Tokenizer

import corpus_pipeline
from cabflow.llm.common import cut, tables_of, written
from cabflow.llm.line_dedup import OP5_SQL
from cabflow.llm.queries import ORACLE_SQL, QUERIES
from cabflow.llm.quality import OP2_SQL


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return out


def pandas(df):
    return df.select("doc_id", "text", "source").toPandas()


def sql(query, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(query)


def test_columns(stages):
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns and out.dtypes == stages[0].dtypes
        assert out.where("n_chars <> length(text)").count() == 0


def test_quality_stage(stages):
    kept = {i for i, k in sql(f"SELECT doc_id, kept FROM ({OP2_SQL})", pandas(stages[0])).fetchall() if k}
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_line_stage(stages):
    rows = sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({OP5_SQL})", pandas(stages[1])).fetchall()
    want = {i: t for i, n, gone, t in rows if n == 0 or gone < n}
    assert {r.doc_id: r.text for r in stages[2].collect()} == want


def test_near_duplicate_stage(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[2].collect())
    sets = [shingle_counts(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i].keys() & sets[j].keys() and naive_jp(sets[i], sets[j]) >= 0.8 - 1e-9]
    want = components_of(len(docs), links)
    assert {r.doc_id for r in stages[3].collect()} == {docs[k][0] for k in set(want)}


def test_mixing_stage(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[3:5])
    assert before == after and stages[4].count() >= len(before)


def test_encoding_stage(stages):
    library = Tokenizer.from_file(WORD_BPE)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[5].collect()))


def test_stages_delete_the_tables_of_those_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = set(written())
    first = cut(corpus_pipeline.quality_stage(spark, docs, "folder"), "one")
    made = set(written()) - before - tables_of(first)
    assert made
    kept = corpus_pipeline.line_stage(spark, first, "other folder")  # another run: nothing goes
    assert made <= set(written())
    second = cut(corpus_pipeline.line_stage(spark, first, "folder"), "two")
    assert not made & set(written()) and tables_of(first) <= set(written())
    assert second.count() == kept.count() <= first.count()
    # Not written in between: what ``docs`` reads stays.
    lazy = corpus_pipeline.line_stage(spark, first, "third")
    assert corpus_pipeline.quality_stage(spark, lazy, "third").count() > 0


def test_stages_on_messy_and_no_rows(spark, messy, empty):
    names = [name for name, _ in corpus_pipeline.STAGES]
    for docs in (messy, empty):
        found = {}
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, SF), "messy")
            if name != names[-1]:
                assert out.columns == docs.columns
                assert all(r["row"] == "old row" and r["kept"] == "old kept" for r in out.collect())
            found[name] = sorted(((r["doc_id"] or 0) for r in out.collect()))
            docs = out
        if not found[names[0]]:
            assert not any(found.values())
        else:
            # Enough words and no repetition; the copies of 5 go; of 7 the end is too short to be a near copy.
            assert found["quality_rules"] == [0, 5, 5, 6, 7, 8, 9]
            assert found["line_dedup"] == [0, 5, 7, 8, 9] == found["near_duplicates"]
            assert set(found["mix_sources"]) == {0, 5, 7, 8, 9} and found["bpe_codec"] == found["mix_sources"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    out = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
