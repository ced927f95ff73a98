"""Trip layers: base -> enriched -> validated -> silver.

All are lazy ``DataFrame -> DataFrame`` functions; Catalyst collapses
base + enrich + validate into one codegen'd scan/project/filter stage.
The only shuffle is the deduplication.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabflow.functions import above, at_least
from cabflow.functions import trips as T
from cabflow.functions.core import LARGEST
from cabflow.sources.layers import as_date
from cabflow.sources.schema import ENRICHED_COLUMNS, TRIP_PARTITION

# Defaults of the source analysis.
FIRST_MONTH = "2013-01-01"


def build_base(raw: DataFrame) -> DataFrame:
    """``trips_base``: trips with a start time, plus their month (first column)."""
    return raw.filter(F.col("trip_start_timestamp").isNotNull()).select(
        T.partition_month("trip_start_timestamp").alias(TRIP_PARTITION), "*"
    )


def enriched_columns() -> list[Column]:
    """The 13 derived columns of the enriched layer, in order."""
    return [
        T.company_clean().alias("company_clean"),
        T.trip_km().alias("trip_km"),
        T.duration_min().alias("duration_min"),
        T.duration_hr().alias("duration_hr"),
        T.avg_speed_kmh().alias("avg_speed_kmh"),
        T.dollars_per_km().alias("dollars_per_km"),
        T.dollars_per_min().alias("dollars_per_min"),
        T.component_sum().alias("component_sum"),
        T.component_gap().alias("component_gap"),
        T.has_geo().alias("has_geo"),
        T.is_airport_trip().alias("is_airport_trip"),
        T.is_total_consistent().alias("is_total_consistent"),
        T.payment_category().alias("payment_category"),
    ]


def enrich(base: DataFrame) -> DataFrame:
    """``v_trips_enriched``: every base column plus the derived ones (a lazy view)."""
    return base.select("*", *enriched_columns())


def quality_rules(
    lo: str | _dt.date = FIRST_MONTH,
    max_total: float = 500.0,
    max_usd_per_km: float = 50.0,
    min_km_for_price: float = 1.0,
    max_seconds: int = 6 * 3600,
    max_km: float = 300.0,
    max_kmh: float = 130.0,
) -> dict[str, Column]:
    """The silver filters as named Boolean columns over the enriched layer.

    They are SQL three-valued predicates: a row is kept only where every one
    is TRUE, so a NULL result drops the row (e.g. a NULL ``trip_miles`` fails
    the price-per-km rule). A comparison with NaN is FALSE, as in the source
    dialect. Do not simplify them.
    """
    fare, tips, total = F.col("fare"), F.col("tips"), F.col("trip_total")
    sec, km = F.col("trip_seconds"), F.col("trip_km")
    zero_sec, zero_km = F.coalesce(sec, F.lit(0)) == 0, F.coalesce(km, F.lit(0.0)) == 0
    return {
        "month_bound": F.col(TRIP_PARTITION) >= F.lit(as_date(lo)),
        "fare_not_negative": fare.isNull() | at_least(fare, 0),
        "tips_not_negative": tips.isNull() | at_least(tips, 0),
        "total_not_negative": total.isNull() | at_least(total, 0),
        "total_capped": total.isNull() | (total <= max_total),
        "price_per_km": ~(above("dollars_per_km", max_usd_per_km) & above(km, min_km_for_price)),
        "end_after_start": F.col("trip_end_timestamp") >= F.col("trip_start_timestamp"),
        "not_ghost": ~(zero_sec & zero_km),
        "duration_capped": sec.isNull() | (sec <= max_seconds),
        "paid_if_moved": ~((F.coalesce(total, F.lit(0.0)) == 0) & ((sec > 0) | above(km, 0))),
        "distance_capped": km.isNull() | (km <= max_km),
        "speed_capped": F.col("avg_speed_kmh").isNull() | (F.col("avg_speed_kmh") <= max_kmh),
    }


def validate(enriched: DataFrame, **rules) -> DataFrame:
    """``validated``: enriched rows passing every quality rule."""
    return enriched.filter(reduce(lambda a, b: a & b, quality_rules(**rules).values()))


# Among copies of one trip (same taxi, same start) keep the highest total,
# then the longest duration and distance; NULLs lose; the smallest key wins ties.
DEDUP_KEYS = ["taxi_id", "trip_start_timestamp"]


def dedup_order() -> list[Column]:
    return [
        F.desc_nulls_last("trip_total"),
        F.desc_nulls_last("trip_seconds"),
        F.desc_nulls_last("trip_miles"),
        F.asc_nulls_first("unique_key"),
    ]


def dedup(validated: DataFrame) -> DataFrame:
    """One row per (taxi_id, trip_start_timestamp); a NULL taxi id is one group.

    Plans as Sort -> WindowGroupLimit(Partial) -> Exchange -> Sort ->
    WindowGroupLimit(Final) -> Window: each map task already keeps only the
    best row of every key it holds, so even a key holding a third of all
    rows sends at most one row per map task through the shuffle. The order
    is total (``unique_key`` last), so a recomputed task picks the same row.
    """
    # The month is a function of the start time: it changes no group, but as a
    # window key it lets month bounds on the result filter the window's input.
    month = [TRIP_PARTITION] if TRIP_PARTITION in validated.columns else []
    w = Window.partitionBy(*DEDUP_KEYS, *month).orderBy(*dedup_order())
    return validated.withColumn("row_num", F.row_number().over(w)).filter(F.col("row_num") == 1).drop("row_num")


#: Words of 64 marks each: 2**26 marks, 16 MB at most, however many trips there are.
MARK_WORDS = 1 << 20


def _mark(key: Column) -> tuple[Column, Column]:
    """Word and bit that mark a dedup key, by its hash."""
    return F.pmod(key, F.lit(MARK_WORDS)), F.shiftrightunsigned(key, 58).cast("int")


def copy_marks(validated: DataFrame) -> DataFrame:
    """Marks (word, bits) of the dedup keys that more than one trip has; only hashes of keys are shuffled."""
    key = F.xxhash64(*DEDUP_KEYS).alias("key")
    word, bit = _mark(F.col("key"))
    shared = validated.select(key).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return shared.select(word.alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("bits"))


def split_copies(validated: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alone, marked): trips that surely have no copy, and the others, among them all that have one.

    ``marks`` are those of ``validated``. Keys that share a mark by chance
    are marked as well, so ``alone`` and ``dedup(marked)`` together are
    exactly ``dedup(validated)``.
    """
    word, bit = _mark(F.xxhash64(*DEDUP_KEYS))
    columns = [F.col(c) for c in validated.columns]
    marked = validated.withColumns({"copy_word": word, "copy_bit": bit})
    held = F.broadcast(marks.select(F.col("word").alias("copy_word"), F.col("bits").alias("copy_bits")))
    found = marked.join(held, "copy_word", "left")
    copied = F.coalesce(F.getbit("copy_bits", F.col("copy_bit")), F.lit(0)) == 1
    return found.where(~copied).select(*columns), found.where(copied).select(*columns)


def validated_base(enriched: DataFrame, **rules) -> DataFrame:
    """Validated trips with only the base columns."""
    derived = set(ENRICHED_COLUMNS)
    return validate(enriched, **rules).select(*[c for c in enriched.columns if c not in derived])


def deduped_base(enriched: DataFrame, **rules) -> DataFrame:
    """Validated, deduplicated trips with only the base columns.

    The derived columns are pure functions of the base ones, so they are
    dropped before the dedup exchange (the filter still evaluates the ones
    it needs) and derived again afterwards: every shuffle of the silver
    build carries the 20 base columns instead of 33.
    """
    return dedup(validated_base(enriched, **rules))


def build_silver(enriched: DataFrame, **rules) -> DataFrame:
    """``trips_silver``: validated and deduplicated (columns as enriched)."""
    return enrich(deduped_base(enriched, **rules))


# Measures of silver that the marts add up.
SUMMED = ["trip_total", "fare", "tips", "trip_km", "duration_min"]


def _unsummable(c: str) -> Column:
    """Values that no exact sum can hold; NaN is the largest value to Spark. Row groups without any are skipped."""
    return (F.col(c) >= LARGEST) | (F.col(c) <= -LARGEST)


def unsummable() -> Column:
    """Whether a silver trip has a measure that no exact sum can hold (NULL or FALSE if not)."""
    return reduce(lambda a, b: a | b, map(_unsummable, SUMMED))


def summable(silver: DataFrame) -> DataFrame:
    """Trips all of whose summed measures fit an exact sum (NULL does)."""
    return silver.filter(~F.coalesce(unsummable(), F.lit(False)))


def set_aside(silver: DataFrame) -> DataFrame:
    """Trips that ``summable`` leaves out, one row for each measure that does not fit."""
    names = [F.when(_unsummable(c), F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))) for c in SUMMED]
    return silver.filter(unsummable()).select(
        TRIP_PARTITION, "unique_key", "taxi_id", "trip_start_timestamp", F.inline(F.array_compact(F.array(*names)))
    )
