"""Source divergence against brute force and SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus_cases import empty, messy

from cabflow.llm.divergence import OP12_SQL, QuadTree, compare, op12_source_divergence, price, source_divergence


def brute(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in own.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def rows_of(pairs, terms):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    out = [(r.lang, r.source, "pair", r.other, r.value, r["rank"]) for r in pairs.withColumn("rank", rank).collect()]
    return sorted(out + [(r.lang, r.source, "term", r.term, r.value, r["rank"]) for r in terms.collect()])


@pytest.mark.parametrize("seed", range(30))
def test_joint_walk_of_two_trees(seed):
    r = np.random.default_rng(seed)
    rows, others, columns = (int(r.integers(1, 20)) for _ in range(3))
    same = seed % 2 == 0
    others = rows if same else others
    shares = [r.integers(1, 10**9, (n, columns)) * (r.random((n, columns)) < r.choice([0.0, 0.05, 0.5, 1.0])) for n in (rows, others)]
    zero = [r.integers(1, 1000, n) for n in (rows, others)]
    if same:
        shares[1], zero[1] = shares[0], zero[0]
    height = 5
    trees = [QuadTree(*np.nonzero(s), height) for s in shares]
    leaves = tuple(s[np.nonzero(s)][t.cell] for s, t in zip(shares, trees))
    got = compare(*trees, leaves, tuple(zero), columns, same)
    full = [np.where(s > 0, s, z[:, None]) for s, z in zip(shares, zero)]
    want = price(full[0][:, None, :], full[1][None, :, :]).sum(axis=2)
    wanted = np.triu(np.ones(want.shape, bool), 1) if same else np.ones(want.shape, bool)
    assert (got[wanted] == want[wanted]).all()


def test_tiles_and_blocks(spark):
    """Many sources and terms: several tiles, several blocks of groups, rows combined in between."""
    small = {"tile_terms": 8, "block_groups": 4, "combined": 50}
    r = random.Random(1)
    rows = []
    for i in range(600):
        lang = r.choice(["en", "de", None, "", "one"])
        source = "only" if lang == "one" else r.choice([None, "", "é", "z", *[f"s{k}" for k in range(9)]])
        rows.append((lang, source, " ".join(r.choice(["Tee", "über", "CAFÉ", "café", "x1y", *[f"w{chr(97 + int(r.expovariate(0.1)) % 26)}" for _ in range(6)]]) for _ in range(r.randint(0, 12)))))
    rows += [("none", "a", None), ("none", "b", "rare terms"), ("none", "c", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(*source_divergence(docs, **small)) == brute(rows)
    assert rows_of(*source_divergence(docs, min_docs=3, top=4, **small)) == brute(rows, 3, 4)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    out = op12_source_divergence(spark, path)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({OP12_SQL})").fetchall()
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(want) and any(r[2] == "term" for r in got)


def test_messy_and_no_rows(spark, messy, empty):
    rows = [(r.lang, r.source, r.text) for r in messy.collect()]
    assert rows_of(*source_divergence(messy)) == brute(rows)
    assert rows_of(*source_divergence(messy, min_docs=2)) == brute(rows, 2)
    pairs, terms = source_divergence(empty)
    assert pairs.count() == terms.count() == 0
    renamed = messy.select(messy["text"].alias("source"), messy["source"].alias("lang"), messy["lang"].alias("a.b"))
    assert rows_of(*source_divergence(renamed, text="source", lang="a.b", source="lang", min_docs=2)) == brute(rows, 2)
