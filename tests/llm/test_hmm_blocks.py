"""Blocks of texts are written once: no round shuffles the texts again, and each block knows the training counts of its words."""

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cabflow.llm import hmm as H
from cabflow.llm.common import Words, cut_by


def test_rows_cut_by_a_key_are_grouped_without_a_shuffle(spark):
    written = cut_by(spark.range(300).select((F.col("id") % 7).cast("int").alias("block"), "id"), "rows", "block", 5)
    sums = written.groupBy("block").applyInArrow(lambda t: pa.table({"block": t["block"][:1], "n": pa.array([sum(t["id"].to_pylist())])}), "block int, n long")
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert {r.block: r.n for r in sums.collect()} == {k: sum(range(k, 300, 7)) for k in range(7)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cabflow_")]


def test_rounds_shuffle_no_texts(spark, monkeypatch):
    plans = []
    cut = H.cut
    monkeypatch.setattr(H, "cut", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), cut(df, name))[1])
    monkeypatch.setattr(H, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame([(i, f"word{i % 9} other{i % 5} end") for i in range(200)], "doc_id long, text string")
    assert H.hmm_scores(docs, states=2, rounds=3).count() == 200
    rounds = [p for name, p in plans if name == "expected-counts"]
    assert len(rounds) == 3
    for plan in rounds:
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # of what ranges send, not of the texts


def test_blocks_hold_the_training_counts_of_their_words(spark, monkeypatch):
    """Words that only held-out texts, one block or all blocks have."""
    monkeypatch.setattr(H, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(H, "RANGE_BYTES", 2000)
    rows = [(i, f"Every text has these and own{i} or pair{i // 2}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in training for w in t.lower().split())
    got = {r.doc_id: r for r in H.hmm_scores(docs, states=2, rounds=1).collect()}
    total = sum(count.values()) + len(training)
    for i, text in rows:
        words = text.lower().split()
        assert (got[i].n_known, got[i].n_tokens, got[i].train_tokens) == (sum(w in count for w in words) + 1, len(words) + 1, total)
        base = sum(np.log10((c + 0.1) / (total + 0.1 * (len(count) + 2))) for c in [*(count[w] for w in words), len(training)])
        assert abs(got[i].base_score - base) < 1e-9


def test_counts_of_a_range_go_back_to_each_block():
    words = [np.sort(Words([t]).hash.view(np.int64)) for t in (b"a b c", b"b c d", b"e")]
    units = [np.array([[1], [2], [3]]), np.array([[10], [20], [0]]), np.array([[0]])]
    sent = pa.table({"block": [0, 1, 2], "range": [0, 0, 0], "words": [H.packed_words(w) for w in words], "units": [H.packed(u) for u in units]})
    want = collections.Counter()
    for w, u in zip(words, units):
        want.update(dict(zip(w.tolist(), u[:, 0].tolist())))
    out = H.add_counts(sent)
    back = [r for r in out.to_pylist() if r["seen"] is not None]
    for r in back:
        assert H.unpacked(r["seen"], 1)[:, 0].tolist() == [want[w] for w in words[r["block"]].tolist()]
    assert len(back) == 3 and {r["word"]: r["n"] for r in out.to_pylist() if r["word"] is not None} == {w: n for w, n in want.items() if n}
