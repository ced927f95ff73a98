r"""MinHash near-dedup by ProbMinHash (operator 4).

A text is the weighted set of its five-word shingles (weight: occurrences).
Each element's arrivals are a Poisson process with the weight as rate, its
randomness seeded by the element's hash; every arrival falls into one of
``bands * rows`` slots, a slot keeps its earliest arrival, and an element is
done once its next arrival is later than all slots' (early termination). Two
texts agree in a slot with the probability Jaccard similarity J_P. Slots are
banded; texts that share a band are candidates, and J_P itself decides
(``>= threshold``).

1. One narrow pass makes the signatures. Texts with equal word sequences
   become one node.
2. Buckets (band values shared by two nodes or more) are counted with
   partial aggregates. Candidate pairs are tested in three rounds, each over
   what the links found before leave in different components: node and
   smallest bucket centre; node and every bucket centre; then the other
   members of buckets that are still divided, unless all of them share a
   bucket of an earlier band, in cells of bounded size. A round's links are
   taken between components, so each next graph is smaller. There a task
   tests every pair from different components until links found join them, and
   passes on only those links, so no link that could join two components
   goes untested and a group of thousands yields no list of pairs.
3. Components of the verified links are the classes.

Rows are numbered in a written table; shingle sets are made for candidates
only. Words are ``[^\x20\x09-\x0D]+``. Defined cases: a text of one to four
words has one shingle, all its words; null, empty and blank texts are linked
with nothing, each a class of its own; a row's ``class_id`` is the smallest
document id of its class (null if all are null); ``kept`` marks the first
row of a class by (doc_id with nulls last, row), so of repeated rows one
stays; columns named like a result are replaced, one named
``row`` is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabflow.llm.common import Words, cut, mix, prepare, release, slices, text_bytes
from cabflow.llm.components import components

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 25, 5, 0.8
#: Members of a bucket that one task compares with as many others, and room for rounding in comparisons.
CELL, SLACK = 500, 1e-9
#: Text bytes taken together.
SLICE_BYTES = 2 << 20
_STEP, _ALL = 0xD1B54A32D192ED03, (1 << 64) - 1
RESULTS = ("class_id", "class_size", "kept")


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of each distinct shingle, sorted by text and element."""
    n = len(words.hash)
    factors = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(n, bool)
    full[: max(0, n - SHINGLE + 1)] = words.doc[: max(0, n - SHINGLE + 1)] == words.doc[SHINGLE - 1 :]
    at = np.flatnonzero(full)
    value = sum((words.hash[at + k] * factors[k] for k in range(SHINGLE)), np.zeros(len(at), np.uint64))
    # Texts of one to four words: all their words are the shingle.
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < SHINGLE))
    extra = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = words.per_doc[short] > k
        extra[has] += words.hash[words.first_word[short[has]] + k] * factors[k]
    doc = np.concatenate((words.doc[at], short))
    value = mix(np.concatenate((value, extra)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.concatenate((first, [len(doc)])))
    return doc[first], value[first], weight


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """ProbMinHash signatures, one row of ``slots`` element hashes per text."""
    best = np.full(n_docs * slots, np.inf)
    sign = np.zeros(n_docs * slots, np.uint64)
    live = np.arange(len(doc))
    time = np.zeros(len(doc))
    step = 0
    while len(live):
        step += 1
        seed = element[live] + np.uint64(2 * step * _STEP & _ALL)
        time[live] -= np.log(_uniform(seed)) / weight[live]
        limit = best.reshape(n_docs, slots).max(axis=1)
        live = live[time[live] < limit[doc[live]]]  # early termination
        seed = mix(element[live] + np.uint64((2 * step + 1) * _STEP & _ALL))
        slot = doc[live] * slots + (seed % np.uint64(slots)).astype(np.int64)
        np.minimum.at(best, slot, time[live])
        won = time[live] == best[slot]
        sign[slot[won]] = element[live[won]]
    return sign.reshape(n_docs, slots)


def band_values(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), np.uint64)
    cells = sign.reshape(len(sign), bands, rows)
    for r in range(rows):
        out = mix(out + cells[:, :, r] + np.uint64(r + 1))
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted distinct elements, weights).

    J_P is the sum over common d of 1 / sum over e of max(A_e / A_d, B_e / B_d);
    the inner maximum is A's term where A_e / B_e >= A_d / B_d and B's elsewhere.
    """
    elements = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(elements)), np.zeros(len(elements))
    wa[np.searchsorted(elements, a[0])] = a[1]
    wb[np.searchsorted(elements, b[0])] = b[1]
    common = (wa > 0) & (wb > 0)
    if not common.any():
        return 0.0
    ratio = np.divide(wa, wb, out=np.full(len(wa), np.inf), where=wb > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb, common = ratio[order], wa[order], wb[order], common[order]
    below_b = np.concatenate(([0.0], np.cumsum(wb)))
    above_a = np.concatenate((np.cumsum(wa[::-1])[::-1], [0.0]))
    at = np.searchsorted(ratio, ratio[common], side="left")
    return float(np.sum(1.0 / (above_a[at] / wa[common] + below_b[at] / wb[common])))


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                words = Words(text_bytes(batch.column("text")))
                doc, element, weight = shingles(words)
                has = np.flatnonzero(words.per_doc)
                sign = signatures(doc, element, weight, batch.num_rows, bands * rows)
                values = band_values(sign[has], bands, rows)
                # Two sums over the word sequence tell equal sequences.
                place = np.arange(len(words.hash)) - words.first_word[words.doc]
                keys = []
                for salt in (1, 2):
                    each = mix(words.hash + mix((place + 1).astype(np.uint64) * np.uint64(salt * 2 + 1)))
                    keys.append(np.add.reduceat(each, words.first_word[has]) if len(has) else np.zeros(0, np.uint64))
                rows_out = np.asarray(batch.column("row"))[has]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * bands, pa.int32()), pa.array(values.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rows_out, pa.int64()), *(pa.array(k.view(np.int64), pa.int64()) for k in keys), flat], names=["row", "k1", "k2", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            doc, element, weight = shingles(Words(text_bytes(batch.column("text"))))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            elements = [element[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            weights = [weight[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:])]
            kept = [batch.column(c) for c in ("row", "a", "is_centre")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(elements, pa.binary()), pa.array(weights, pa.binary())], names=["node", "a", "is_centre", "elements", "weights"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for s in "ab":
                pairs = zip(batch.column(f"elements_{s}").to_pylist(), batch.column(f"weights_{s}").to_pylist())
                sides.append([(np.frombuffer(e, np.uint64), np.frombuffer(w, np.uint32)) for e, w in pairs])
            linked = pa.array([similarity(x, y) >= threshold - SLACK for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("component"), linked], names=["a", "b", "linked"])

    return run


def _join_cell(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of components that a link joins in one pair of parts of a bucket.

        Each pair from different components is tested, in the first band
        where the two meet; pairs that links found here have joined need not be.
        """
        table = table.combine_chunks()
        table = table.take(pa.array(np.argsort(np.asarray(table.column("node")), kind="stable")))
        node, part = np.asarray(table.column("node")), np.asarray(table.column("part"))
        component, label = np.unique(np.asarray(table.column("component")), return_inverse=True)
        own_component = component[label]
        band, first, second = (table.column(c)[0].as_py() for c in ("band", "first", "second"))
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(node), -1)
        sets = [(np.frombuffer(e, np.uint64), np.frombuffer(w, np.uint32)) for e, w in zip(table.column("elements").to_pylist(), table.column("weights").to_pylist())]
        sizes = np.array([len(e) for e, _ in sets])
        start = np.cumsum(sizes) - sizes
        known, flat = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
        weight = np.concatenate([w for _, w in sets]).astype(np.float64)
        total = np.add.reduceat(weight, start)
        plain = total == sizes  # no shingle twice
        mark = np.zeros(len(known))
        links = []
        right = np.flatnonzero(part == second)
        for i in np.flatnonzero(part == first).tolist():
            others = right[right > i] if first == second else right
            others = others[label[others] != label[i]]
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            if not len(others):
                continue
            own = flat[start[i] : start[i] + sizes[i]]
            mark[own] = 1.0
            held = mark[flat]
            common = np.add.reduceat(held, start)[others]
            # J_P is at most the share of either text's weight in common shingles.
            near = np.add.reduceat(held * weight, start)[others] >= (threshold - SLACK) * total[others]
            mark[own] = 0.0
            for j, n in zip(others[near].tolist(), common[near].tolist()):
                if label[j] != label[i]:
                    same = n / (sizes[i] + sizes[j] - n) if plain[i] and plain[j] else similarity(sets[i], sets[j])
                    if same >= threshold - SLACK:
                        links.append((own_component[i], own_component[j]))
                        label[label == label[j]] = label[i]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicate_nodes(rows: DataFrame, bands: int, rows_per_band: int, threshold: float) -> DataFrame:
    """(row, node, component) of every row with a word, a written table; so is ``rows`` (row, text)."""
    signed = cut(rows.mapInArrow(_sign(bands, rows_per_band), "row long, k1 long, k2 long, bands array<long>"), "signatures")
    nodes = cut(signed.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    shared = cut(banded.join(buckets.drop("n"), ["band", "value"]), "shared-bands")

    # Each candidate with its smallest centre, so that its set goes straight there in the first round.
    candidates = shared.groupBy(F.col("node").alias("row")).agg(F.min("centre").alias("a"), F.max(F.col("node") == F.col("centre")).alias("is_centre"))
    sets = rows.join(candidates, "row").select("row", "text", "a", "is_centre")
    sets = cut(sets.mapInArrow(_sets, "node long, a long, is_centre boolean, elements binary, weights binary"), "shingle-sets")
    centre_sets = sets.where("is_centre").select(F.col("node").alias("a"), F.col("elements").alias("elements_a"), F.col("weights").alias("weights_a"))
    member_sets = sets.select(F.col("node").alias("b"), F.col("elements").alias("elements_b"), F.col("weights").alias("weights_b"), F.col("a").alias("nearest"))

    def joined(pairs: DataFrame, name: str) -> DataFrame:
        """Components of components: ``pairs`` (a: a centre, b's set, and the present components of both), tested and linked."""
        sides = [f"{c}_{s}" for s in "ab" for c in ("elements", "weights")]
        tested = pairs.join(centre_sets, "a").select("of", "component", *sides).mapInArrow(_verify(threshold), "a long, b long, linked boolean")
        return components(tested.where("linked").select("a", "b"), name)

    def resolved(nodes: DataFrame, node: str, component: str, found: list[DataFrame]) -> DataFrame:
        """``nodes`` with ``node``'s present component: each of ``found`` joins components of those before it."""
        nodes = nodes.withColumn(component, F.col(node))
        for known in found:
            after = known.select(F.col("node").alias(component), F.col("component").alias("_after"))
            nodes = nodes.join(after, component, "left").withColumn(component, F.coalesce("_after", component)).drop("_after")
        return nodes

    first = member_sets.where("nearest < b").withColumns({"a": F.col("nearest"), "of": F.col("nearest"), "component": F.col("b")})
    found = [joined(first, "components-1")]

    second = resolved(resolved(shared, "node", "component", found), "centre", "of", found).where("of != component")
    second = second.select(F.col("centre").alias("a"), F.col("node").alias("b"), "of", "component").distinct()
    # A member has met its smallest centre.
    found.append(joined(second.join(member_sets, "b").where("a != nearest"), "components-2"))

    # Every member has met its centre; what is left are the pairs of other members.
    at = resolved(shared.where("node != centre").select("band", "value", "node"), "node", "component", found)
    at = cut(at.select("band", "value", "node", "component"), "bands-components")
    release(shared)
    sizes = at.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    divided = at.join(sizes.where("low < high").select("band", "value", "n"), ["band", "value"]).join(nodes.select("node", "bands"), "node")
    divided = cut(divided, "divided-buckets")
    release(at)
    # Members that all share a bucket of an earlier band as well have met there.
    same = F.array(*(F.min(F.col("bands")[k]) == F.max(F.col("bands")[k]) for k in range(bands)))
    new = divided.groupBy("band", "value").agg(same.alias("same")).where(~F.array_contains(F.slice("same", F.lit(1), F.col("band")), True))
    cells = divided.join(new.select("band", "value"), ["band", "value"])
    cells = cells.withColumn("parts", F.ceil(F.col("n") / F.lit(CELL)).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other")).drop("n", "parts", "other")
    cells = cells.join(sets.select("node", "elements", "weights"), "node")
    links = cells.groupBy("band", "value", "first", "second").applyInArrow(_join_cell(threshold), "a long, b long")
    found.append(components(links, "components-3"))
    release(divided)
    release(sets)

    member = signed.select("row", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("row", "node")
    placed = cut(resolved(member, "node", "component", found).select("row", "node", "component"), "row-components")
    release(signed)
    release(nodes)
    return placed


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """``docs`` with ``class_id``, ``class_size`` and ``kept``."""
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in (*RESULTS, "row") if c not in (text, doc_id)])
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("row", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = near_duplicate_nodes(texts, bands, rows_per_band, threshold)
    ids = rows.select("row", F.col(doc_id).alias("id")).join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    first = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("row"))).alias("first")
    classes = ids.groupBy("component").agg(first, F.count("*").alias("class_size"))
    labels = ids.join(classes, "component").select("row", F.col("first.id").alias("class_id"), "class_size", (F.col("first.row") == F.col("row")).alias("kept"))
    return rows.join(labels, "row").select(*docs.columns, *RESULTS)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("text")
