"""Expression tests on inline rows: the named derivations and the traps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F, types as T

from cabflow.functions import above, at_least, exact_sum, round_dec, safe_div
from cabflow.functions import trips as D


def one_col(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype, True)]))


def test_company_clean(spark):
    values = ["Foo Cab Co. . ", "...", None, "\tFoo Cab ", " Bar Taxi.\n", "Plain", "A.B. Cab.", "  Lead"]
    df = one_col(spark, values, T.StringType())
    got = [r[0] for r in df.select(D.company_clean("v")).collect()]
    assert got == ["Foo Cab Co", "", D.UNKNOWN_COMPANY, "Foo Cab", "Bar Taxi", "Plain", "A.B. Cab", "Lead"]


def test_payment_category(spark):
    cases = {
        "Credit Card": "Card",
        "Prcard": "Card",
        "Pcard": "Card",
        "Prepaid": "Card",
        "Way2ride": "Card",
        "CREDIT CARD": "Card",
        "Cash": "Cash",
        "Mobile": "Mobile",
        "No Charge": "No Charge/Dispute",
        "Dispute": "No Charge/Dispute",
        "Unknown": "Other/Unknown",
        "Split": "Other/Unknown",
        "Barter": "Other/Unknown",
        None: "Other/Unknown",
    }
    df = one_col(spark, list(cases), T.StringType())
    got = dict(df.select("v", D.payment_category("v").alias("c")).collect())
    assert got == cases


def test_is_airport_trip_three_valued(spark):
    rows = [(76, None), (None, 8), (8, 32), (None, None), (56, 8), (8, 56)]
    df = spark.createDataFrame(rows, "p long, d long")
    got = [r[0] for r in df.select(D.is_airport_trip("p", "d")).collect()]
    assert got == [True, None, False, None, True, True]


def test_airport_segment_and_name(spark):
    rows = [(56, 76), (76, 56), (56, 8), (8, 56), (8, 32), (8, 76)]
    df = spark.createDataFrame(rows, "p long, d long")
    got = [tuple(r) for r in df.select(D.airport_segment("p", "d"), D.airport_name("p", "d")).collect()]
    assert got == [
        ("Airport Pickup", "OHare"),
        ("Airport Pickup", "OHare"),
        ("Airport Pickup", "Midway"),
        ("Airport Dropoff", "Midway"),
        ("Non-Airport", "City"),
        ("Airport Dropoff", "OHare"),
    ]


def test_calendar_names(spark):
    df = one_col(spark, [dt.date(2019, m, 1) for m in range(1, 13)], T.DateType())
    got = df.select(D.month_name("v"), D.season(F.month("v"))).collect()
    assert [r[0] for r in got][:3] == ["January", "February", "March"]
    assert [r[1] for r in got] == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
    days = one_col(spark, list(range(1, 8)), T.IntegerType()).select(D.day_name("v")).collect()
    assert [r[0] for r in days] == list(D.DAY_NAMES)


def test_safe_div_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (90.0, 60.0), (1.005, 1.0)], "a double, b double")
    got = df.select(safe_div("a", "b").alias("q"), round_dec(safe_div("a", "b"), 2).alias("r")).collect()
    assert [r.q for r in got] == [None, None, 1.5, 1.005]
    assert [r.r for r in got] == [None, None, 1.5, 1.01]


def test_float_literals_stay_double(spark):
    df = spark.createDataFrame([(90,)], "s long")
    out = df.select(D.duration_min("s").alias("m"))
    assert out.schema["m"].dataType == T.DoubleType()
    assert out.first().m == 1.5


def test_exact_sum_is_order_independent(spark):
    values = [0.1] * 10 + [1e6, -1e6, 0.7, 0.2]
    a = one_col(spark, values, T.DoubleType())
    b = one_col(spark, list(reversed(values)), T.DoubleType()).repartition(5)
    got_a = a.agg(exact_sum("v").alias("s")).first().s
    got_b = b.agg(exact_sum("v").alias("s")).first().s
    assert got_a == got_b == 1.9
    assert one_col(spark, [None, None], T.DoubleType()).agg(exact_sum("v").alias("s")).first().s is None


N = None
# FIXTURES §4: km, total, sec -> (price rule, not ghost, not unpaid); None = SQL NULL.
TRUTH_TABLE = [
    (None, 10.0, 60, (N, True, True)),
    (5.0, None, 60, (N, True, False)),
    (0.5, None, 60, (True, True, False)),
    (0.0, 10.0, 60, (True, True, True)),
    (None, None, 0, (N, False, N)),
    (5.0, 10.0, None, (True, True, True)),
    (0.0, None, None, (True, False, N)),
    (0.0, 0.0, -5, (True, True, True)),
    (-1.0, 0.0, -5, (True, True, True)),
    (0.8, 60.0, 300, (True, True, True)),
    (2.0, 100.0, 300, (True, True, True)),
    (2.0, 100.1, 300, (False, True, True)),
]


def test_silver_filters_three_valued(spark):
    from cabflow.operators import layers

    rows = [(km, total, sec) for km, total, sec, _ in TRUTH_TABLE]
    df = spark.createDataFrame(rows, "trip_km double, trip_total double, trip_seconds long")
    df = df.withColumn("dollars_per_km", safe_div("trip_total", "trip_km"))
    rules = layers.quality_rules()
    got = [
        tuple(r)
        for r in df.select(rules["price_per_km"], rules["not_ghost"], rules["paid_if_moved"]).collect()
    ]
    assert got == [expected for *_, expected in TRUTH_TABLE]


def test_validate_keeps_only_all_true(spark):
    """A row survives only if every rule is TRUE (NULL drops it)."""
    from cabflow.operators import layers
    from cabflow.sources.schema import RAW_SCHEMA

    start = dt.datetime(2018, 5, 1, 10, 0)

    def raw_row(miles, total, seconds, end_offset=60):
        row = {name: None for name in RAW_SCHEMA.names}
        row.update(
            unique_key=f"k{miles}{total}{seconds}",
            taxi_id="t",
            trip_start_timestamp=start,
            trip_end_timestamp=None if end_offset is None else start + dt.timedelta(seconds=end_offset),
            trip_seconds=seconds,
            trip_miles=miles,
            fare=total,
            trip_total=total,
        )
        return tuple(row[n] for n in RAW_SCHEMA.names)

    rows = [
        raw_row(2.0, 10.0, 600),  # kept
        raw_row(None, 10.0, 600),  # NULL miles: price rule NULL
        raw_row(2.0, 10.0, 600, end_offset=None),  # NULL end
        raw_row(2.0, 10.0, 21601),  # over 6 h
        raw_row(2.0, 500.01, 600),  # over $500
        raw_row(200.0, 300.0, 3600),  # over 300 km
        raw_row(2.0, -1.0, 600),  # negative total
    ]
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    kept = layers.validate(layers.enrich(layers.build_base(raw))).collect()
    assert [(r.trip_miles, r.trip_total, r.trip_seconds) for r in kept] == [(2.0, 10.0, 600)]


def test_dedup_order_and_null_taxi(spark):
    from cabflow.operators import layers

    start = dt.datetime(2018, 5, 1, 10, 0)
    rows = [
        # same taxi + start: NULL total loses, then highest total wins
        ("a1", "T1", start, None, 600, 2.0),
        ("a2", "T1", start, 12.0, 600, 2.0),
        ("a3", "T1", start, 11.0, 900, 9.0),
        # tie on total: longer duration wins; then longer distance; then smallest key
        ("b2", "T2", start, 10.0, 600, 3.0),
        ("b1", "T2", start, 10.0, 600, 3.0),
        ("b3", "T2", start, 10.0, 600, 2.0),
        # NULL taxi ids with the same start collapse into one group
        ("c1", None, start, 5.0, 60, 1.0),
        ("c2", None, start, 6.0, 60, 1.0),
    ]
    df = spark.createDataFrame(
        rows, "unique_key string, taxi_id string, trip_start_timestamp timestamp, trip_total double, "
        "trip_seconds long, trip_miles double"
    )
    got = sorted(r.unique_key for r in layers.dedup(df).collect())
    assert got == ["a2", "b1", "c2"]


def test_company_clean_same_in_oracle_dialect(spark):
    """Tabs, NBSP, thin/ideographic spaces, VT and dot runs: Spark = DuckDB text."""
    import duckdb

    from cabflow.functions.trips import TRAILING_DOTS_SPACE, UNICODE_TRIM

    names = ["Foo Cab Co. . ", "...", "\tFoo Cab ", " Bar Taxi.\n", "A.B. Cab.", " Lead ", "x. ",
             "　Wide　", "Tab\x0b"]
    sql = (
        f"SELECT regexp_replace(regexp_replace(c, '{TRAILING_DOTS_SPACE}', ''), '{UNICODE_TRIM}', '', 'g') "
        "FROM (SELECT unnest($1) AS c)"
    )
    duck = [r[0] for r in duckdb.connect().execute(sql, [names]).fetchall()]
    df = one_col(spark, names, T.StringType())
    assert [r[0] for r in df.select(D.company_clean("v")).collect()] == duck


def test_sums_lose_nothing(spark):
    """Fractions of a cent add up; what no exact decimal holds is an error, never left out."""
    small = spark.range(1000).select(F.lit(0.004).alias("v"))
    assert small.agg(exact_sum("v").alias("s")).first().s == 4.0
    for odd in (1e27, float("nan"), float("inf")):
        values = one_col(spark, [1.0, odd], T.DoubleType())
        with pytest.raises(Exception, match="no exact decimal"):
            values.agg(exact_sum("v").alias("s")).collect()
        with pytest.raises(Exception, match="no exact decimal"):
            values.select(round_dec("v", 2)).collect()


def test_no_silent_casts():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "cabflow")):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "try_cast" not in file.read().lower(), name


def test_company_end_anchor(spark):
    df = one_col(spark, ["abc.\u0085", "abc. .", "\tZeta\u00a0Cab\u00a0. "], T.StringType())
    got = [r.c for r in df.select(D.company_clean("v").alias("c")).collect()]
    assert got == ["abc.", "abc", "Zeta\u00a0Cab"]


def test_comparisons_with_nan_are_false(spark):
    nan = float("nan")
    df = one_col(spark, [None, nan, -1.0, 0.0, 1.0, float("inf")], T.DoubleType())
    rows = df.select(above("v", 0), at_least("v", 0), ~above("v", 0)).collect()
    assert [r[0] for r in rows] == [None, False, False, False, True, True]
    assert [r[1] for r in rows] == [None, False, False, True, True, True]
    assert [r[2] for r in rows] == [None, True, True, True, False, False]


def test_silver_rules_reject_nan_and_audits_do_not_count_it(spark):
    """fare, tips, total and distance: each alone NaN."""
    from cabflow.operators import audits, layers

    nan, start = float("nan"), dt.datetime(2019, 3, 1, 8, 0)
    good = {"fare": 10.0, "tips": 1.0, "trip_total": 11.0, "trip_miles": 2.0}
    rows = [{**good, **odd} for odd in ({}, *({c: nan} for c in good), {"tolls": nan})]
    base = spark.createDataFrame(
        [
            (str(i), "T", start, start + dt.timedelta(minutes=10), 600, r["trip_miles"], r["fare"], r["tips"], r.get("tolls"), None, r["trip_total"], "Cash", None, 8, 8, start.date().replace(day=1))
            for i, r in enumerate(rows)
        ],
        "unique_key string, taxi_id string, trip_start_timestamp timestamp, trip_end_timestamp timestamp, trip_seconds long,"
        " trip_miles double, fare double, tips double, tolls double, extras double, trip_total double, payment_type string,"
        " company string, pickup_community_area long, dropoff_community_area long, partition_month date",
    )
    enriched = layers.enrich(base)
    assert [r.unique_key for r in layers.validate(enriched).orderBy("unique_key").collect()] == ["0", "5"]
    counts = enriched.agg(*[F.count_if(c).alias(n) for n, c in audits.anomaly_flags().items()]).first()
    assert counts.extreme_total == counts.impossible_speed == counts.extreme_distance == counts.extreme_cost_min == counts.ghost_trips == 0
    assert counts.total_mismatch == 4  # NaN fare, tips, total and tolls


def test_unsummable_measures(spark):
    from cabflow.operators import layers

    inf = float("inf")
    rows = [("a", 1.0, None), ("b", inf, 2.0), ("c", -1e15, float("nan")), ("d", 9.99e14, None), ("e", None, None)]
    silver = spark.createDataFrame(rows, "unique_key string, fare double, tips double").select(
        "*",
        F.lit("T").alias("taxi_id"),
        F.lit(dt.datetime(2019, 3, 1)).alias("trip_start_timestamp"),
        F.lit(dt.date(2019, 3, 1)).alias("partition_month"),
        *[F.lit(1.0).alias(c) for c in ("trip_total", "trip_km", "duration_min")],
    )
    assert [r.unique_key for r in layers.summable(silver).collect()] == ["a", "d", "e"]
    found = {(r.unique_key, r.measure, repr(r.value)) for r in layers.set_aside(silver).collect()}
    assert found == {("b", "fare", "inf"), ("c", "fare", "-1000000000000000.0"), ("c", "tips", "nan")}
