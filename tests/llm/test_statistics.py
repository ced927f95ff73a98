"""Quality rules, mixing and the language model."""

import collections
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from corpus_cases import SF, documents, plain
from pyspark.sql import functions as F

from cabflow.llm import hmm as H
from cabflow.llm import mixing as X
from cabflow.llm import quality as Q


def test_lines_of_a_hot_host_have_a_limit_that_does_not_grow(spark):
    """Of 600 documents of one host 3 % hold one line, 2 % another, and nearly all of two documents is the first."""
    own = lambda i: f"document number {i} has words of its own in this line and no others hold it at all"
    often, seldom = "subscribe to our news letter here today and never miss any story of ours", "the second shared line"
    rows = [(i, "hot", own(i) + (f"\n{often}" if i < 18 else f"\n{seldom}" if i < 30 else "")) for i in range(600)]
    rows += [(1000, "hot", f"{often}\nshort end"), (1001, "other", f"{often}\nshort end"), (1002, "hot", f"{often}\n{own(1002)}")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in Q.quality_rules(docs, clean=True, max_docs=12).collect()}
    assert [i for i, r in got.items() if not r.kept] == [1000] and not got[1000].base_failed
    assert sorted(i for i, r in got.items() if r.n_removed_lines) == [*range(18), 1000, 1002]
    assert got[3].text == own(3) and seldom in got[20].text and got[1001].text == f"{often}\nshort end"
    lax = Q.quality_rules(docs).collect()  # a share of 10 % alone leaves both lines
    assert all(r.kept and not r.n_removed_lines for r in lax)


def test_quality_equals_sql(spark):
    """Documents with lines above the limit, some of them depleted."""
    import pandas as pd

    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(150):
        body = [line(rng.randint(1, 25)) for _ in range(rng.randint(0, 5))]
        body += ["Subscribe  to OUR letter now for news and more and more and yet more"] * (i % 3 == 0)
        body += ["subscribe to our letter now for news and more and more and yet more\t", "Subscribe"] * (i % 4 == 0)
        body += body[:1] * (i % 7 == 0) + [line(8) + " " + "a b c d e " * 4] * (i % 11 == 0)
        rows.append((i, "\n".join(body) if i % 50 else None, f"h{i % 2}" if i % 5 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    out = Q.quality_rules(docs).select("doc_id", *Q.RESULTS)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({Q.OP2_SQL})").fetchall()
    got = list(map(tuple, out.collect()))
    assert sorted(got) == sorted(want)
    assert sum(r[7] for r in got) > 50 and any(not r[9] and not r[6] for r in got)
    cleaned = {r.doc_id: r for r in Q.quality_rules(docs, clean=True).collect()}
    for i, text, _ in rows:
        if cleaned[i].n_removed_lines:
            left = cleaned[i].text.split()
            assert len(left) == cleaned[i].n_kept_words and len(left) < len(text.split())
        else:
            assert cleaned[i].text == text


def test_copies_of_one_text_are_one_document(spark):
    rows = [(i, "a line that very many copies of one text share with no one else at all", "h") for i in range(60)]
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept and r.n_removed_lines == 0 for r in got)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 0.001}, {f"s{k}": 1 + k % 7 for k in range(90)}])
def test_period_is_pfair(weights):
    quota = X.quotas(weights, 1000)
    assert sum(quota.values()) == 1000 and min(quota.values()) >= 1
    used = collections.Counter()
    for slot, (s, j, at, release, due) in enumerate(X.period(quota)):
        assert at == slot and release <= slot < due and j == used[s]
        used[s] += 1
        for t, q in quota.items():
            assert abs(used[t] - q * (slot + 1) / 1000) < 1
    assert used == quota


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["hot"] * 8 + ["b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    weights = {"hot": 0.5, "b": 0.3, "c": 0.15, "": 0.05}
    got = X.mix_sources(docs, weights, block_bytes=500, resolution=200, bucket_rows=50).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in rows}  # everything comes at least once
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    source_of = {}
    for r in got:
        assert source_of.setdefault(r.slot, r.source) == r.source
    end = max(source_of) + 1
    used = collections.Counter()
    for slot in range(end):
        if slot in source_of:  # a slot is empty where a long document covers it
            used[source_of[slot] or ""] += 1
    assert max(r.copy for r in got if r.source == "b") >= 1
    # In each source a block holds at most its bytes and one document more.
    size = dict((i, len(t)) for i, t, _ in rows)
    filled = collections.Counter()
    for r in got:
        filled[r.source, r.block] += size[r.doc_id]
    assert max(filled.values()) <= 500 + 300
    for s, w in weights.items():
        assert abs(sum(n for (t, _), n in filled.items() if (t or "") == s) / sum(filled.values()) - w) < 0.03
    again = X.mix_sources(docs.repartition(2), weights, block_bytes=500, resolution=200, bucket_rows=50).collect()
    assert sorted((r.doc_id, r.copy, r.slot) for r in again) == sorted((r.doc_id, r.copy, r.slot) for r in got)
    with pytest.raises(ValueError, match="no positive weight"):
        X.mix_sources(docs, {"hot": 1.0}).collect()


def earliest_deadline_first(quota, resolution, slots):
    """(source, block) of every slot, each block of each source scheduled on its own, without periods."""
    at, out = collections.Counter(), []
    for slot in range(slots):
        released = [s for s in quota if at[s] * resolution // quota[s] <= slot]
        s = min(released, key=lambda s: (-(-(at[s] + 1) * resolution // quota[s]), s))
        out.append((s, at[s]))
        at[s] += 1
    return out


def test_mix_equals_earliest_deadline_first_over_many_periods(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["hot"] * 8 + ["b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    weights = {"hot": 0.5, "b": 0.27, "c": 0.16, "": 0.07}
    got = X.mix_sources(docs, weights, block_bytes=500, resolution=20, bucket_rows=50).collect()
    end = max(r.slot for r in got) + 1
    quota = X.quotas(weights, 20)
    assert end > 200 and sum(quota.values()) == 20
    want = earliest_deadline_first(quota, 20, end)
    assert all(want[r.slot] == (r.source or "", r.block) for r in got)
    used = collections.Counter()
    for slot, (s, _) in enumerate(want, 1):
        used[s] += 1
        # Less than one block from the target at every slot, in whole numbers.
        assert all(abs(used[t] * 20 - slot * q) < 20 for t, q in quota.items())


def test_more_sources_than_slots(spark):
    """20,000 sources, one of them with a third of the rows: all are mixed, none loses a document."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("some text of a page").alias("text"), F.when(F.col("id") < 20_000, F.concat(F.lit("s"), "id")).otherwise(F.lit("s7")).alias("source")
    )
    got = X.mix_sources(docs, block_bytes=1000)
    assert got.agg(F.count_distinct("doc_id")).first()[0] == 30_000
    assert got.where("slot < release or slot >= deadline").count() == 0
    assert got.groupBy("slot").agg(F.count_distinct("source").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="more than 100"):
        X.mix_sources(docs, most_sources=100)


def test_quotas_give_back_from_the_largest():
    quota = X.quotas({"hot": 1e6, "warm": 1e3, **{f"s{i}": 1e-6 for i in range(50)}}, 100)
    assert sum(quota.values()) == 100 and min(quota.values()) == 1 and quota["hot"] == 49 and quota["warm"] == 1


def toy_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((H.SYMBOLS, states)) * 1e-9
    emit[:symbols] = rng.random((symbols, states))
    move = rng.random((states, states))
    start = rng.random(states)
    return H.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def path_sums(model, sequence):
    """Total probability and expected emissions by listing every path of states."""
    states = len(model.start)
    total, emitted = 0.0, np.zeros((H.SYMBOLS, states))
    moved, began = np.zeros((states, states)), np.zeros(states)
    paths = []
    for path in itertools.product(range(states), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= model.move[path[t - 1], path[t]] * model.emit[sequence[t], path[t]]
        paths.append((path, p))
        total += p
    for path, p in paths:
        began[path[0]] += p / total
        for t, z in enumerate(path):
            emitted[sequence[t], z] += p / total
            if t:
                moved[path[t - 1], z] += p / total
    return total, began, moved, emitted


def test_forward_and_backward_equal_path_sums():
    model = toy_model()
    sequences = [[0, 3, 2, 4, 1, 0], [2], [4, 4, 1]]
    flat = np.concatenate([np.array(s) for s in sequences])
    sizes = np.array([len(s) for s in sequences])
    starts = np.cumsum(sizes) - sizes
    want = [path_sums(model, s) for s in sequences]
    assert H.log_likelihood(model, flat, starts, sizes) == pytest.approx([math.log10(w[0]) for w in want])
    counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((H.SYMBOLS, 3))]
    H.forward_backward(model, flat, starts, sizes, counts)
    for k in range(3):
        assert counts[k] == pytest.approx(sum(w[k + 1] for w in want))


def test_long_sequences_do_not_underflow():
    model = toy_model()
    n = 50_000
    flat = np.arange(n) % 5
    got = H.log_likelihood(model, flat, np.array([0]), np.array([n]))
    assert np.isfinite(got).all() and got[0] < -n / 10


def test_scores(spark, documents):
    docs = plain()
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = {i: [*(t or "").encode().translate(lower).split(), None] for i, t, _ in docs}
    train = collections.Counter()
    for i, *_ in docs:
        if zlib.crc32(str(i).encode()) % 10:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in H.hmm_scores(documents).collect()}
    held_base = held = held_tokens = 0
    for i, *_ in docs:
        r = got[i]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(w in train for w in tokens[i]), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.base_score == pytest.approx(base)
        if r.held_out:
            held, held_base, held_tokens = held + r.score, held_base + r.base_score, held_tokens + r.n_tokens
    assert held / held_tokens > held_base / held_tokens + 0.1


def test_word_probabilities_add_up_to_one():
    own = [(10, 50), (-7, 20)]
    known = H.Counts(tokens=100, distinct=9, texts=10, once=4, own=own, classes={10 % H.CLASSES: 50 + 6, -7 % H.CLASSES: 20, 5: 10})
    words = np.array([10, -7, 10 + H.CLASSES, 5, 1, 2, 3, 4, 99])
    counts = np.array([50, 20, 6, 10, 1, 1, 1, 1, 0])
    symbol, share = known.symbols(words, counts)
    total = collections.Counter()
    for s, p in zip(symbol.tolist(), share.tolist()):
        total[s] += 10**p
    assert all(x == pytest.approx(1) for x in total.values()) and H.END not in total


def test_rounds_raise_the_likelihood(spark, documents):
    few, more = (sum(r.score for r in H.hmm_scores(documents, rounds=k).collect() if not r.held_out) for k in (1, 4))
    assert more > few
