"""Near-duplicates, repeats, line runs, embeddings and components against brute force."""

import collections
import random

import duckdb
import numpy as np
import pytest
from corpus_cases import SF, components_of, plain
from pyspark.sql import functions as F

from cabflow.llm import embedding_dedup as E
from cabflow.llm import line_dedup as L
from cabflow.llm import minhash as M
from cabflow.llm import repeats as R
from cabflow.llm.common import Words, cut
from cabflow.llm.components import components


def shingle_counts(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return collections.Counter([tuple(words)] if words else [])
    return collections.Counter(zip(*(words[k:] for k in range(5))))


def naive_jp(a, b):
    both = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in a.keys() & b.keys())


def test_similarity_and_signatures():
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(60)) for _ in range(6)]
    texts += [t + " " + texts[0][:40] for t in texts[:3]]
    doc, element, weight = M.shingles(Words([t.encode() for t in texts]))
    sets = [(element[doc == i], weight[doc == i]) for i in range(len(texts))]
    sign = M.signatures(doc, element, weight, len(texts), 4000)
    for i in range(len(texts)):
        for j in range(i):
            exact = naive_jp(shingle_counts(texts[i]), shingle_counts(texts[j]))
            assert M.similarity(sets[i], sets[j]) == pytest.approx(exact)
            assert np.mean(sign[i] == sign[j]) == pytest.approx(exact, abs=0.05)


def family(rng, n_words, copies, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(n_words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_classes_equal_brute_force(spark, monkeypatch):
    """Families around the threshold, one larger than a cell, and the given documents."""
    monkeypatch.setattr(M, "CELL", 12)
    rng = random.Random(3)
    texts = [t for _, t, _ in plain()][:120]
    for edits in (0, 1, 2, 3):
        texts += family(rng, 100, 40, edits)
    texts += [texts[0], "short one", "short one", "short  one"]
    sets = [shingle_counts(t) for t in texts]
    links = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 2 * sum((a & b).values()) >= 0.5 * (sum(a.values()) + sum(b.values())) and naive_jp(a, b) >= 0.8 - 1e-9:
                links.append((i, j))
    want = components_of(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = M.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    assert sum(r.kept for r in got) == len(set(want))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    want = components_of(400, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for link in links if link[0] != link[1] for i in link}


def brute_repeats(rows, depth):
    first, out = {}, {}
    for i, text in sorted(rows):
        covered = np.zeros(len(text), bool)
        for at in range(len(text) - depth + 1):
            if first.setdefault(text[at : at + depth], i) < i:
                covered[at : at + depth] = True
        out[i] = covered
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 700)
    monkeypatch.setattr(R, "RANGE_BYTES", 256)
    rng = random.Random(7)
    parts = ["".join(rng.choice("abé \n") for _ in range(rng.randint(10, 90))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))).encode()) for i in range(150)]
    rows += [(200, b"q" * 400), (201, b"q" * 300), (202, rows[3][1])]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(4)
    want = brute_repeats(rows, 50)
    text = dict(rows)
    for r in R.suffix_dedup(docs, block_bytes=4000).collect():
        keep = ~want[r.doc_id]
        assert bytes(r.kept) == bytes(np.frombuffer(text[r.doc_id], np.uint8)[keep]), r.doc_id
        spans = np.flatnonzero(np.diff(np.concatenate(([0], (~keep).astype(int), [0])))).reshape(-1, 2)
        assert [(s.start, s.length) for s in r.spans] == [(a, b - a) for a, b in spans.tolist()]


def sql_rows(sql, table):
    con = duckdb.connect()
    con.register("documents", table)
    return con.execute(f"SELECT doc_id, n_lines, n_removed, n_runs, text FROM ({sql})").fetchall()


def test_line_runs_equal_sql(spark):
    rng = random.Random(11)
    lines = [f"line {k}" for k in range(6)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = L.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.size(F.coalesce("runs", F.array())).alias("n_runs"), "text")
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    import pandas as pd

    table = pd.DataFrame(rows, columns=["doc_id", "text"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(sql_rows(L.OP5_SQL, table), key=str)


def maximal_runs_removed(docs, min_lines, min_words):
    """Texts without later copies of maximal runs; from every place the longest run that stands earlier."""
    before, out = [], {}
    for i, ls in docs:
        gone = set()
        for at in range(len(ls)):
            longest = 0
            for other, start in [(o, s) for o in before for s in range(len(o))] + [(ls, s) for s in range(at)]:
                n = 0
                while at + n < len(ls) and start + n < len(other) and other[start + n] == ls[at + n]:
                    n += 1
                longest = max(longest, n)
            if longest >= min_lines or sum(len(x.split()) for x in ls[at : at + longest]) >= min_words:
                gone |= set(range(at, at + longest))
        before.append(ls)
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


@pytest.mark.parametrize("seed, min_lines, min_words", [(1, 3, 9), (2, 3, 5), (3, 5, 11), (4, 2, 1), (5, 4, 1000)])
def test_maximal_runs_by_lines_or_words(spark, seed, min_lines, min_words):
    rng = random.Random(seed)
    lines = ["one", "two words", "three words here", "four words in line", "a line of five words", "a b c d e f g h i j"]
    rows = [(i, [rng.choice(lines) + rng.choice(["", "", f" {rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 12))]) for i in range(40)]
    docs = spark.createDataFrame([(i, "\n".join(ls)) for i, ls in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in L.line_dedup(docs, min_lines=min_lines, min_words=min_words).collect()}
    assert got == maximal_runs_removed(rows, min_lines, min_words)


def test_copies_of_one_long_line_go(spark):
    """Later copies by size: one line of 50 words and two of 25 go, shorter ones of one or two lines stay."""
    words = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n))
    passage = {"one": words(50, "a"), "two": words(25, "b") + "\n" + words(25, "c"), "short": words(49, "d"), "both": words(24, "e") + "\n" + words(25, "f")}
    rows = [(10 * k + j, f"start {k} {j}\n{p}\nend {k} {j}") for k, p in enumerate(passage.values()) for j in range(3)]
    out = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = {r.doc_id: r.n_removed for r in out}
    assert [lost[10 * k + j] for k in range(4) for j in range(3)] == [0, 1, 1, 0, 2, 2, 0, 0, 0, 0, 0, 0]
    found = L.line_dedup(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    seen = set()
    for r in found.orderBy("doc_id").collect():
        for line in (r.text or "").split("\n"):
            if len(line.split()) >= 50:
                assert line not in seen
                seen.add(line)


def test_helper_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x", "y", 1), (2, "a\nb\nc\nd", "x", "y", 2)], "doc_id long, text string, _lines string, lines string, `a.b` int")
    out = L.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "runs"]
    assert sorted((r.doc_id, r.text, r._lines, r.lines, r["a.b"]) for r in out.collect()) == [(1, "a\nb\nc", "x", "y", 1), (2, "d", "x", "y", 2)]


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_line_runs_of_other_lengths(spark, depth):
    rng = random.Random(depth)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 20))]) for i in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(ls)) for i, ls in rows], "doc_id long, text string")
    seen = set()
    want = {}
    for i, ls in rows:
        gone = set()
        for at in range(len(ls) - depth + 1):
            key = tuple(ls[at : at + depth])
            if key in seen:
                gone |= set(range(at, at + depth))
            seen.add(key)
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    assert {r.doc_id: r.text for r in L.line_dedup(docs, min_lines=depth).collect()} == want


def test_embeddings_equal_brute_force(spark):
    """Clusters around the threshold, a group of copies, and buckets divided into parts."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = np.concatenate([c + 0.25 * rng.normal(size=(30, 24)) for c in centres] + [np.repeat(centres[:1], 50, axis=0), rng.normal(size=(200, 24))])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    degree = np.bincount(np.concatenate((i, j)), minlength=len(vectors))
    want = components_of(len(vectors), zip(i.tolist(), j.tolist()))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame, bucket_rows=40, recall=0.99999).collect()}
    assert got == {k: (int(degree[k]), want[k], want[k] == k) for k in range(len(vectors))}


def test_recall_bound_of_the_tables():
    rng = np.random.default_rng(4)
    bits, tables = E.plan_tables(10**6, 0.9, 0.999, 1024)
    a = rng.normal(size=(2000, 64))
    b = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    planes = E.hyperplanes(64, bits, tables, 0)
    same = ((a @ planes >= 0) == (b @ planes >= 0)).reshape(2000, tables, bits).all(2).any(1)
    assert same.mean() >= 0.99


def test_settled_links_take_no_round(spark, monkeypatch):
    """Stars around their smallest nodes are components already; other links take rounds until they are."""
    import cabflow.llm.components as module

    names = []
    monkeypatch.setattr(module, "cut", lambda df, name: names.append(name) or cut(df, name))
    stars = [(9, 1), (1, 8), (7, 1), (5, 2), (2, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 7: 1, 8: 1, 9: 1, 2: 2, 5: 2} and names == ["components"]
    path = [(k, k + 1) for k in range(1, 12)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 13)} and len(names) > 2
