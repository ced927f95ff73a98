"""Audit of how sources differ in their terms, by K-squared quadtrees (operator 12).

For every language the counts of its kept terms (those in at least
``min_docs`` of its documents) in its sources form a matrix, groups by terms,
most of whose cells are 0. Two groups are compared by the sum over all kept
terms of ``floor((p - q)**2 / (p + q))``, with ``p`` and ``q`` their smoothed
shares in parts per billion; a group and its language by the largest such
addends of the group's own terms.

The matrix is cut into tiles of about ``TILE_TERMS`` terms and ``BLOCK_GROUPS``
groups. A task turns a tile into K-squared quadtrees (``QuadTree``): a level
tells for each of the K x K children of every node that is not all zero
whether it is. The trees of two blocks of groups are then walked together, all pairs
of groups at once (``compare``): where both quadrants are all zero the pair's
price is known without looking further, as the share of a count of 0 depends
on the group alone: the number of terms is added up and multiplied at the
end. Quadrants of which one is not zero are descended to their leaves.

Stages: one pass counts terms, combined in the task before they are sent; one
shuffle by (language, term) sums them and drops rare terms; tiles are dealt
out; their partial sums are added up by pair. Terms are spread by hash, so
neither a frequent term nor a large source makes a large task; a tile holds
``TILE_TERMS * 2 * BLOCK_GROUPS`` cells at most (about; terms are dealt by
hash). With more than ``BLOCK_GROUPS`` sources in a language a cell goes to
one tile for each block of partners; the result itself has a row for every
pair of sources. Shares are computed in exact decimals, addends in 64-bit
integers (a share is a billion and one at most).

Defined cases: null text, language and source count as empty strings; a
group without terms takes part with counts of 0; a language without kept
terms gives pairs of value 0 and no terms; a language with one source has no
pairs; repeated rows are documents of their own; no rows give no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabflow.llm.common import cut, prepare, slices, text_bytes

#: Children of a quadtree node a side.
K = 2
#: Terms of a tile (on average) and groups of a block.
TILE_TERMS = 256
BLOCK_GROUPS = 64
#: Rows of counts that a task combines before it sends them.
COMBINED = 400_000

#: ASCII letters and all bytes beyond ASCII belong to terms; A-Z are lowered.
_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# ------------------------------------------------------------------ counting


def count_terms(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of each group's terms; ``group`` numbers the texts' groups."""
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer.translate(_LOWER), np.uint8)
    inside = _TERM[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[inside].tobytes()))
    coded = terms.dictionary_encode()
    code = np.asarray(coded.indices, np.int64)
    size = max(1, len(coded.dictionary))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    in_doc, times = np.unique(doc * size + code, return_counts=True)
    cell = group[in_doc // size] * size + in_doc % size
    by = np.argsort(cell, kind="stable")
    cell, first, docs = np.unique(cell[by], return_index=True, return_counts=True)
    counts = np.add.reduceat(times[by], first) if len(first) else np.zeros(0, np.int64)
    return cell // size, coded.dictionary.take(pa.array(cell % size)), counts, docs


def _added(parts: list[pa.Table]) -> pa.Table:
    """The rows of all parts, summed by (lang, source, term)."""
    added = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table({"lang": added["lang"], "source": added["source"], "term": added["term"], "n": added["n_sum"], "docs": added["docs_sum"]})


def term_counts(docs: DataFrame, combined: int = COMBINED) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
                numbers: dict[tuple[str, str], int] = {}
                group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(langs, sources)], np.int64)
                names = list(numbers)
                at, term, n, seen = count_terms(text_bytes(batch.column("text")), group)
                at = pa.array(at)
                held.append(
                    pa.table(
                        {
                            "lang": pa.array([g[0] for g in names], pa.string()).take(at),
                            "source": pa.array([g[1] for g in names], pa.string()).take(at),
                            "term": term.cast(pa.string()),
                            "n": pa.array(n, pa.int64()),
                            "docs": pa.array(seen, pa.int64()),
                        }
                    )
                )
                rows += len(at)
                if rows > combined:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if rows > combined // 2:
                        yield from held.pop().to_batches(max_chunksize=50_000)
                        rows = 0
        if held:
            yield from _added(held).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


# ------------------------------------------------------------------ quadtree


class QuadTree:
    """A K-squared tree over the non-zero cells of a matrix.

    ``child[level][node, k]`` is the number on the next level of the node's
    child ``k`` (row-major), -1 where the child is all zero; only nodes that
    are not all zero have a row. The leaves are the cells in the order of the
    last level; ``cell`` is the index of each in the input.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int):
        # Cells in the order of the walk: digits of row and column to the base K, alternating.
        path = np.zeros(len(rows), np.int64)
        for level in range(height - 1, -1, -1):
            digit = (rows // K**level) % K * K + (columns // K**level) % K
            path = path * (K * K) + digit
        self.cell = np.argsort(path, kind="stable")
        path = path[self.cell]
        self.child: list[np.ndarray] = []
        for level in range(height - 1, -1, -1):
            below = np.unique(path // (K * K) ** level)
            nodes, node = np.unique(below // (K * K), return_inverse=True)
            child = np.full((max(1, len(nodes)), K * K), -1, np.int64)
            child[node, below % (K * K)] = np.arange(len(below))
            self.child.append(child)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))``, exact: shares are a billion and one at most."""
    apart = p - q
    return apart * apart // np.maximum(p + q, 1)


def compare(
    one: QuadTree,
    other: QuadTree,
    shares: tuple[np.ndarray, np.ndarray],
    zero: tuple[np.ndarray, np.ndarray],
    terms: int,
    same: bool,
) -> np.ndarray:
    """Prices of all pairs (row of ``one``, row of ``other``) summed over the ``terms`` columns.

    ``shares`` are those of the trees' leaves, ``zero`` those of a count of 0
    in each row. With ``same`` the trees are one and only pairs of a smaller
    and a larger row are filled in.
    """
    height = len(one.child)
    sizes = (len(zero[0]), len(zero[1]))
    total = np.zeros(sizes, np.int64)
    empty = np.zeros(sizes, np.int64)  # columns in which both rows are 0
    # Quadrants met: node of either tree (-1: all zero), block of rows of either, block of columns.
    node, with_, row, beside, column = (np.zeros(1, np.int64) for _ in range(5))
    if not one.cell.size:
        node = node - 1
    if not other.cell.size:
        with_ = with_ - 1
    for level in range(height + 1):
        side = K ** (height - level)  # rows and columns of a block here
        nothing = (node < 0) & (with_ < 0)
        if nothing.any():
            # All zero on both sides: only the number of columns is kept, for the whole blocks of rows.
            blocks = np.zeros((-(-sizes[0] // side), -(-sizes[1] // side)), np.int64)
            width = np.minimum(terms, (column[nothing] + 1) * side) - column[nothing] * side
            np.add.at(blocks, (row[nothing], beside[nothing]), width)
            spread = np.repeat(np.repeat(blocks, side, 0)[: sizes[0]], side, 1)[:, : sizes[1]]
            empty += spread
        node, with_, row, beside, column = (x[~nothing] for x in (node, with_, row, beside, column))
        if level == height or not len(node):
            break
        met = []
        lower = side // K
        for r in range(K):
            for b in range(K):
                for c in range(K):
                    rows, besides, columns = row * K + r, beside * K + b, column * K + c
                    real = (rows * lower < sizes[0]) & (besides * lower < sizes[1]) & (columns * lower < terms)
                    if same:
                        real &= besides >= rows
                    nodes = np.where(node < 0, -1, one.child[level][node, r * K + c])
                    withs = np.where(with_ < 0, -1, other.child[level][with_, b * K + c])
                    met.append([x[real] for x in (nodes, withs, rows, besides, columns)])
        node, with_, row, beside, column = (np.concatenate(x) for x in zip(*met))
    if len(node):  # leaves: single cells, one of each pair not 0
        p = np.where(node < 0, zero[0][row], np.append(shares[0], 0)[node])
        q = np.where(with_ < 0, zero[1][beside], np.append(shares[1], 0)[with_])
        np.add.at(total, (row, beside), price(p, q))
    total += empty * price(zero[0][:, None], zero[1][None, :])
    return total


def tile_prices(group: np.ndarray, term: np.ndarray, share: np.ndarray, zero: dict[int, int], blocks: tuple[int, int], width: int) -> tuple:
    """(group, partner, price, number of terms) of every pair of groups of the two blocks in a tile.

    ``group``, ``term`` and ``share`` are its non-zero cells, ``zero`` the
    share of a count of 0 for each group of the blocks of ``width`` groups.
    """
    groups = [np.array(sorted(g for g in zero if g // width == b), np.int64) for b in blocks]
    _, column = np.unique(term, return_inverse=True) if len(term) else (None, np.zeros(0, np.int64))
    terms = int(column.max()) + 1 if len(column) else 0
    if terms:
        # Terms of the same groups stand together, so that zeros fill whole quadrants.
        seen = np.zeros((terms, len(zero)), bool)
        every = np.array(sorted(zero), np.int64)
        seen[column, np.searchsorted(every, group)] = True
        place = np.empty(terms, np.int64)
        place[np.lexsort(seen.T[::-1])] = np.arange(terms)
        column = place[column]
    largest = max(len(groups[0]), len(groups[1]), terms, 1)
    height = 1
    while K**height < largest:
        height += 1
    trees, shares = [], []
    for block, numbers in zip(blocks, groups):
        own = group // width == block
        tree = QuadTree(np.searchsorted(numbers, group[own]), column[own], height)
        trees.append(tree)
        shares.append(share[own][tree.cell])
    zeros = [np.array([zero[int(g)] for g in numbers], np.int64) for numbers in groups]
    same = blocks[0] == blocks[1]
    total = compare(trees[0], trees[1], tuple(shares), tuple(zeros), terms, same)
    i, j = np.meshgrid(np.arange(len(groups[0])), np.arange(len(groups[1])), indexing="ij")
    wanted = (i < j) if same else np.ones(total.shape, bool)
    return groups[0][i[wanted]], groups[1][j[wanted]], total[wanted], terms


# ------------------------------------------------------------------ operator


def _share(n: str, total: str, terms: str) -> F.Column:
    """``1 + floor(10**9 * (n + 2) / (total + 2 * terms))`` in exact decimals; null without terms."""
    return F.expr(
        f"1 + (1000000000 * CAST({n} + 2 AS DECIMAL(20, 0))) div nullif(CAST({total} + 2 * {terms} AS DECIMAL(20, 0)), CAST(0 AS DECIMAL(20, 0)))"
    )


def _price(p: str, q: str) -> F.Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 10,
    top: int = 10,
    tile_terms: int = TILE_TERMS,
    block_groups: int = BLOCK_GROUPS,
    combined: int = COMBINED,
) -> tuple[DataFrame, DataFrame]:
    """Pairs (lang, source, other, value) of sources, and each source's ``top`` terms (lang, source, term, value, rank).

    See the module docstring for the values and the cases.
    """
    prepare(docs.sparkSession)
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    by_term = Window.partitionBy("lang", "term")
    kept = cut(
        term_counts(docs, combined)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select(
            "lang",
            "term",
            "source",
            "n",
            F.sum("docs").over(by_term).alias("docs"),
            F.sum("n").over(by_term).alias("lang_n"),
            (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"),
        )
        .where(F.col("docs") >= min_docs)
        .drop("docs"),
        "divergence-terms",
    )
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    per_lang = Window.partitionBy("lang")
    groups = cut(
        docs.groupBy("lang", "source")
        .agg(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("firsts"))
        .unionByName(sums)
        .groupBy("lang", "source")
        .agg(F.sum("total").alias("total"), F.sum("firsts").alias("firsts"))
        .select(
            "lang",
            "source",
            "total",
            F.sum("total").over(per_lang).alias("lang_total"),
            F.sum("firsts").over(per_lang).alias("terms"),
            F.count(F.lit(1)).over(per_lang).alias("n_groups"),
            (F.row_number().over(per_lang.orderBy("source")) - 1).cast("long").alias("number"),
        )
        .select(
            "*",
            _share("0L", "total", "terms").alias("zero"),
            F.expr(f"number div {block_groups}").alias("block"),
            F.expr(f"(n_groups - 1) div {block_groups}").alias("last_block"),
            F.expr(f"greatest(1L, (terms + {tile_terms - 1}) div {tile_terms})").alias("tiles"),
        ),
        "divergence-groups",
    )
    cells = kept.join(groups, ["lang", "source"]).withColumn("share", _share("n", "total", "terms"))

    # Tiles: cells and, for every tile, the groups of its blocks (a null term).
    partners = F.expr("explode(transform(sequence(0L, last_block), b -> struct(least(b, block) AS one, greatest(b, block) AS other)))")
    tiled = cells.select("lang", F.expr("pmod(xxhash64(term), tiles)").alias("tile"), "number", "term", "share", "block", "last_block")
    heads = groups.select(
        "lang",
        F.expr("explode(sequence(0L, tiles - 1))").alias("tile"),
        "number",
        F.lit(None).cast("string").alias("term"),
        F.coalesce("zero", F.lit(0).cast("long")).alias("share"),
        "block",
        "last_block",
    )
    dealt = tiled.unionByName(heads).select("lang", "tile", "number", "term", "share", partners.alias("blocks")).select("lang", "tile", "number", "term", "share", "blocks.*")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang_, _, one, other = (k.as_py() for k in key)
        number = np.asarray(table["number"], np.int64)
        share = np.asarray(table["share"], np.int64)
        head = np.asarray(table["term"].is_null())
        term = np.asarray(table["term"].combine_chunks().dictionary_encode().indices.fill_null(-1), np.int64)
        zero = dict(zip(number[head].tolist(), share[head].tolist()))
        a, b, value, terms = tile_prices(number[~head], term[~head], share[~head], zero, (one, other), block_groups)
        return pa.table(
            {
                "lang": pa.array([lang_] * len(a), pa.string()),
                "one": pa.array(a, pa.int64()),
                "other": pa.array(b, pa.int64()),
                "value": pa.array(value, pa.int64()),
                "seen": pa.array(np.full(len(a), terms, np.int64)),
            }
        )

    priced = (
        dealt.groupBy("lang", "tile", "one", "other")
        .applyInArrow(run, "lang string, one long, other long, value long, seen long")
        .groupBy("lang", "one", "other")
        .agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    names = groups.select("lang", "number", "source", "zero", "terms")
    left = names.select("lang", F.col("number").alias("one"), F.col("source").alias("source_one"), F.col("zero").alias("zero_one"), "terms")
    right = names.select("lang", F.col("number").alias("other"), F.col("source").alias("source_other"), F.col("zero").alias("zero_other"))
    # Terms that no group of a tile's blocks has are zero quadrants as well.
    unseen = F.coalesce(F.col("terms") - F.col("seen"), F.lit(0)) * F.coalesce(_price("zero_one", "zero_other"), F.lit(0))
    both = F.explode(
        F.array(
            F.struct(F.col("source_one").alias("source"), F.col("source_other").alias("other")),
            F.struct(F.col("source_other").alias("source"), F.col("source_one").alias("other")),
        )
    )
    pairs = (
        priced.join(left, ["lang", "one"])
        .join(right, ["lang", "other"])
        .select("lang", (F.col("value") + unseen).alias("value"), both.alias("pair"))
        .select("lang", "pair.source", "pair.other", "value")
    )

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = (
        cells.withColumn("lang_share", _share("lang_n", "lang_total", "terms"))
        .where("share > lang_share")
        .select("lang", "source", "term", _price("share", "lang_share").alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )
    return pairs, terms


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All pairs of sources and each source's ten terms over ``documents``, in one table."""
    pairs, terms = source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pair_rows = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(ranked).alias("rank"))
    return pair_rows.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
grps AS (
  SELECT lang, source, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total + 2 * l.v) AS lang_p
  FROM grps g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
own AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - lang_p) * (p - lang_p) // (p + lang_p) AS value
  FROM cells WHERE n > 0 AND p > lang_p)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM own)
QUALIFY part = 'pair' OR rank <= 10
"""
