"""Adapter: raw taxi trips derived from the driver's ``lineitem`` table.

The test tables carry no taxi data, so trips are derived row by row from
``lineitem`` with (almost only) integer arithmetic; the same derivation is
written as DuckDB SQL in ``cabflow.plans.oracle``. Each line item is a
trip; every 50th order is posted twice (``cp = 1``, ten cents dearer) so
that deduplication has work. Two small firms, one with odd white space,
trips without a taxi id, fractions of a cent and negative amounts give the
filters of every layer rows to drop, some measures are NaN, and the last
month has trips on one day only. The result grows linearly with ``lineitem``
and is one narrow, codegen'd projection (plus a generator for the
copies): no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cabflow.sources.schema import RAW_COLUMNS, RAW_SCHEMA

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def _dollars(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100)


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Map ``lineitem`` rows to raw trip rows (see the module docstring)."""
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ln = F.col("l_linenumber").cast("long")
    nan = F.lit(float("nan"))
    card_words = ("Credit Card", "Mobile", "Prcard")
    other_pt = (
        F.when(ok % 7 == 0, "No Charge")
        .when(ok % 7 == 1, "Dispute")
        .when(ok % 7 == 2, "Pcard")
        .when(ok % 7 == 3, "Split")
        .when(ok % 7 == 4, "Prepaid")
        .when(ok % 7 == 5, "Way2ride")
    )
    pk20 = pk % 20
    pt = (
        F.when(pk20 <= 8, "Cash")
        .when(pk20 <= 15, "Credit Card")
        .when(pk20 == 16, "Mobile")
        .when(pk20 == 17, "Prcard")
        .when(pk20 == 18, "Unknown")
        .otherwise(other_pt)
    )
    pa = (
        F.when(ok % 11 == 0, F.lit(None).cast("long"))
        .when(pk % 10 < 3, F.lit(8).cast("long"))
        .when(pk % 10 < 5, F.lit(32).cast("long"))
        .when(pk % 10 == 5, F.lit(76).cast("long"))
        .when(pk % 10 == 6, F.lit(56).cast("long"))
        .otherwise(1 + ((pk - pk % 10) / 10).cast("long") % 77)
    )
    da = (
        F.when(pk % 9 == 0, F.lit(None).cast("long"))
        .when(ok % 10 < 3, F.lit(8).cast("long"))
        .when(ok % 10 < 5, F.lit(28).cast("long"))
        .when(ok % 10 == 5, F.lit(76).cast("long"))
        .when(ok % 10 == 6, F.lit(56).cast("long"))
        .otherwise(1 + ((ok - ok % 10) / 10).cast("long") % 77)
    )
    posted = (
        F.col("l_shipdate")
        + _days(6575 + (ok % 5) * 365)
        + _minutes(((pk * 7 + ln * 3) % 24) * 60 + (sk % 4) * 15)
    )
    # The last month's feed breaks off: all its trips carry the first day.
    broken = (F.year(posted) == 2023) & (F.month(posted) == 11)
    st = F.when(broken, posted - _days(F.dayofmonth(posted) - 1)).otherwise(posted)
    a = lineitem.select(
        ok.alias("ok"),
        pk.alias("pk"),
        sk.alias("sk"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("ep"),
        ln.alias("ln"),
        st.alias("st"),
        (5 + (ok * 3 + ln) % 200).alias("m10"),
        pt.alias("pt"),
        pa.alias("pa"),
        da.alias("da"),
    )

    ok, pk, sk, ln, m10 = (F.col(c) for c in ("ok", "pk", "sk", "ln", "m10"))
    b = a.select(
        "*",
        (325 + 22 * m10).alias("fc"),
        F.when(F.col("pt").isin(*card_words), (ok * 13 + pk) % 700).otherwise(F.lit(0).cast("long")).alias("tc"),
        F.when(pk % 223 == 0, F.lit(None).cast("double"))
        .when(pk % 251 == 0, nan)
        .when(ok % 17 == 0, F.lit(0.0))
        .when(ok % 997 == 0, F.lit(250.0))
        .otherwise(m10.cast("double") / 10)
        .alias("mi"),
        F.when(pk % 211 == 0, F.lit(None).cast("long"))
        .when(pk % 13 == 0, F.lit(0).cast("long"))
        .when(pk % 499 == 0, F.lit(30000).cast("long"))
        .when(pk % 61 == 0, F.lit(60).cast("long"))
        .otherwise(60 * (((m10 - m10 % 5) / 5).cast("long") + 1 + pk % 15))
        .alias("sec"),
    )
    null_ts = F.lit(None).cast(lineitem.schema["l_shipdate"].dataType)
    st, fc, tc, mi, sec, pa, da = (F.col(c) for c in ("st", "fc", "tc", "mi", "sec", "pa", "da"))

    def unique_key(copy: int) -> Column:
        parts = [F.col(c).cast("string") for c in ("ok", "ln", "pk", "sk", "ep")]
        return F.concat_ws("-", *parts, F.lit(str(copy)))

    def trip_total(copy: int) -> Column:
        cents = (
            fc
            + tc
            + F.when(ln == 7, F.lit(150)).otherwise(F.lit(0))
            + (ln % 4) * 100
            + F.when(pk % 37 == 0, F.lit(500)).otherwise(F.lit(0))
            + copy * 10
        )
        return (
            F.when(pk % 233 == 0, F.lit(None).cast("double"))
            .when(ok % 509 == 0, nan)
            .when(ok % 31 == 0, F.lit(0.0))
            .when(ok % 1013 == 0, F.lit(650.0))
            .when(ok % 503 == 0, F.lit(-5.0))
            .otherwise(_dollars(cents))
        )

    company = (
        F.when(ok % 97 == 0, "Epsilon Cab")
        .when(ok % 193 == 0, "\tZeta\u00a0Taxi\u00a0. ")
        .when(sk % 10 <= 2, "Alpha Cab")
        .when(sk % 10 == 3, "Alpha Cab.")
        .when(sk % 10 == 4, "Beta Taxi. . ")
        .when(sk % 10 == 5, "Beta Taxi")
        .when(sk % 10 == 6, "Gamma Cars Inc.")
        .when(sk % 10 <= 8, "Delta Service")
    )
    fields = {
        "taxi_id": F.when(ok % 53 != 0, F.concat(F.lit("T"), sk.cast("string"))),
        "trip_start_timestamp": F.when(ok % 1499 == 0, null_ts).otherwise(st),
        "trip_end_timestamp": F.when(ok % 401 == 0, null_ts)
        .when(ok % 307 == 0, st - F.make_dt_interval(hours=F.lit(1)))
        .otherwise(st + _seconds(F.coalesce(sec, F.lit(0).cast("long")))),
        "trip_seconds": sec,
        "trip_miles": mi,
        "pickup_census_tract": F.when(ln <= 2, F.lit(None).cast("long")).otherwise(17031000000 + pa * 100),
        "dropoff_census_tract": F.when(ln <= 2, F.lit(None).cast("long")).otherwise(17031000000 + da * 100),
        "pickup_community_area": pa,
        "dropoff_community_area": da,
        "fare": F.when(pk % 227 == 0, F.lit(None).cast("double"))
        .when(pk % 239 == 0, nan)
        .when(ok % 1009 == 0, -fc.cast("double") / 100)
        .when(pk % 41 == 0, (fc * 10 + 4).cast("double") / 1000)
        .otherwise(_dollars(fc)),
        "tips": F.when(pk % 229 == 0, F.lit(None).cast("double"))
        .when(pk % 241 == 0, nan)
        .when(ok % 499 == 0, _dollars(-tc - 1))
        .otherwise(_dollars(tc)),
        "tolls": F.when(pk % 257 == 0, nan).when(ln == 7, F.lit(1.5)).otherwise(F.lit(0.0)),
        "extras": (ln % 4).cast("double"),
        "payment_type": F.col("pt"),
        "company": company,
        "pickup_latitude": 41 + pa.cast("double") / 100,
        "pickup_longitude": -87 - pa.cast("double") / 100,
        "dropoff_latitude": 41 + da.cast("double") / 100,
        "dropoff_longitude": -87 - da.cast("double") / 100,
        "pickup_location": F.when(pa.isNull(), F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("POINT ("), pa.cast("string"), F.lit(" 41)"))
        ),
        "dropoff_location": F.when(da.isNull(), F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("POINT ("), da.cast("string"), F.lit(" 41)"))
        ),
    }
    c = b.select(
        F.col("ok"),
        *[expr.alias(name) for name, expr in fields.items()],
        unique_key(0).alias("unique_key_0"),
        unique_key(1).alias("unique_key_1"),
        trip_total(0).alias("trip_total_0"),
        trip_total(1).alias("trip_total_1"),
    )

    def trip(copy: int) -> Column:
        """One trip row as a struct of plain column references."""
        pick = {"unique_key": f"unique_key_{copy}", "trip_total": f"trip_total_{copy}"}
        return F.struct(*[F.col(pick.get(name, name)).alias(name) for name in RAW_COLUMNS])

    # Every 50th order is posted twice. The trips come out of a generator,
    # so later predicates stay above it instead of being inlined into the
    # synthetic columns below, and each generated method stays small enough
    # for the JIT.
    copies = F.when(F.col("ok") % 50 == 0, F.array(trip(0), trip(1))).otherwise(F.array(trip(0)))
    return c.select(F.inline(copies))


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips for a test-data folder (reads only the six columns it needs)."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)
    return trips_from_lineitem(lineitem)


def land_raw(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the derived raw trips as Parquet in the declared raw schema.

    Timestamps become UTC instants (``TIMESTAMP``), as in the public table;
    the session runs in UTC, so the wall-clock values are unchanged.
    """
    trips = raw_trips(spark, sf_dir)
    trips.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]).write.mode(
        "overwrite"
    ).parquet(path)
