"""Layer round trip: partitioned writes, the scan guard, pruning, refresh = lazy."""

import glob
import os
import uuid

import pytest

from pyspark.sql import functions as F

from cabflow.plans.check import plan_text
from cabflow.plans.queries import QUERIES
from cabflow.plans.refresh import build_layers, layer_reports
from cabflow.sources.fixture import raw_trips
from cabflow.sources.layers import PartitionFilterRequired, read_layer

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def paths(spark, scratch):
    root = os.path.join(scratch, f"layers-{uuid.uuid4().hex[:8]}")
    return build_layers(spark, raw_trips(spark, SF_SMALL), root)


def test_layers_are_month_partitioned(paths):
    for layer, column in (("trips_base", "partition_month"), ("mart_geo_flows", "month_start")):
        (write,) = glob.glob(f"{paths[layer]}/layer_write_id=*")
        folders = [d for d in os.listdir(write) if "=" in d]
        assert len(folders) > 50 and all(d.startswith(f"{column}=") for d in folders)


def test_guard_requires_month_bound(spark, paths):
    for layer in ("trips_base", "trips_silver", "mart_company_performance", "mart_time_analysis"):
        with pytest.raises(PartitionFilterRequired):
            read_layer(spark, paths[layer], layer)
    # the geo mart may be scanned whole
    assert read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows").count() > 0


def test_month_bound_prunes_partitions(spark, paths):
    df = read_layer(spark, paths["trips_silver"], "trips_silver", lo="2017-01-01", hi="2017-03-01")
    plan = plan_text(df.select("trip_total"))
    assert "PartitionFilters: [isnotnull(partition_month" in plan
    assert "2017-01-01" in plan and "2017-03-01" in plan
    months = {r.partition_month.isoformat() for r in df.select("partition_month").distinct().collect()}
    assert months <= {"2017-01-01", "2017-02-01", "2017-03-01"} and months


def test_written_layers_equal_lazy_queries(spark, paths):
    for name in ("trips_silver", "mart_company_performance", "mart_time_analysis", "mart_geo_flows"):
        lo = "2013-01-01" if name != "mart_geo_flows" else None
        written = read_layer(spark, paths[name], name, lo=lo)
        lazy = QUERIES[name](spark, SF_SMALL)
        assert written.count() == lazy.count()
        assert written.select(lazy.columns).exceptAll(lazy).count() == 0, name


def test_reports_on_written_marts_equal_lazy(spark, paths):
    for name, df in layer_reports(spark, paths).items():
        lazy = QUERIES[name](spark, SF_SMALL)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, lazy.collect())), name


def test_command_line_refresh(spark, scratch, capsys):
    import json

    from cabflow.__main__ import main
    from cabflow.sources.fixture import land_raw

    root = os.path.join(scratch, f"cli-{uuid.uuid4().hex[:8]}")
    land_raw(spark, SF_SMALL, f"{root}/raw")
    main(["refresh", "--raw", f"{root}/raw", "--root", f"{root}/out"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["set_aside"] == []
    assert set(out["layers"]) == {"trips_base", "audit_profile", "trips_silver", "trips_set_aside", "mart_company_performance", "mart_time_analysis", "mart_geo_flows"}
    airport = spark.read.parquet(f"{root}/out/reports/report_airport_segments")
    assert airport.count() == 5
    lazy = QUERIES["report_airport_segments"](spark, SF_SMALL)
    assert sorted(map(repr, airport.select(lazy.columns).collect())) == sorted(map(repr, lazy.collect()))


@pytest.mark.parametrize("lo,hi", [("2019-01-01", "2019-12-01"), ("2018-04-01", "2018-06-01")])
def test_month_range_refresh_equals_full_rebuild(spark, scratch, paths, lo, hi):
    """Rebuild a layer set whose trips of [lo, hi] were missing, for those months only."""
    from pyspark.sql import functions as F

    root = os.path.join(scratch, f"incr-{uuid.uuid4().hex[:8]}")
    raw = raw_trips(spark, SF_SMALL)
    month = F.trunc(F.to_date("trip_start_timestamp"), "month")
    build_layers(spark, raw.filter(~month.between(lo, hi) | month.isNull()), root)
    build_layers(spark, raw, root, months=(lo, hi))
    for name in (
        "trips_base",
        "audit_profile",
        "trips_silver",
        "mart_company_performance",
        "mart_time_analysis",
        "mart_geo_flows",
    ):
        lo = "2013-01-01" if name != "mart_geo_flows" else None
        incremental = read_layer(spark, f"{root}/{name}", name, lo=lo)
        full = read_layer(spark, paths[name], name, lo=lo)
        assert incremental.count() == full.count(), name
        assert incremental.exceptAll(full.select(incremental.columns)).count() == 0, name


def test_refresh_removes_a_month_that_became_empty(spark, scratch):
    from pyspark.sql import functions as F

    root, whole = (os.path.join(scratch, f"gone-{uuid.uuid4().hex[:8]}") for _ in range(2))
    raw = raw_trips(spark, SF_SMALL)
    corrected = raw.filter(F.trunc("trip_start_timestamp", "month") != "2018-03-01")
    build_layers(spark, raw, root)
    build_layers(spark, corrected, root, months=("2018-03-01", "2018-03-01"))
    build_layers(spark, corrected, whole)
    for name in ("trips_base", "audit_profile", "trips_silver", "mart_company_performance", "mart_time_analysis", "mart_geo_flows"):
        lo = None if name == "mart_geo_flows" else "2013-01-01"
        got, want = (read_layer(spark, f"{r}/{name}", name, lo=lo) for r in (root, whole))
        assert got.count() == want.count(), name
        assert got.exceptAll(want.select(got.columns)).count() == 0, name


def test_failed_write_leaves_the_old_layer(spark, paths):
    from pyspark.sql import functions as F

    from cabflow.sources.layers import write_layer

    before = read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows")
    rows = before.count()
    failing = before.withColumn("trip_count", F.when(F.col("trip_count") > 0, F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        write_layer(failing, paths["mart_geo_flows"], "mart_geo_flows")
    assert read_layer(spark, paths["mart_geo_flows"], "mart_geo_flows").count() == rows


def test_files_of_a_split_month_hold_disjoint_keys(spark, scratch):
    """A month over several range partitions: no two files' company ranges overlap."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from cabflow.operators.layers import build_base
    from cabflow.sources.layers import write_layer

    path = os.path.join(scratch, f"clustered-{uuid.uuid4().hex[:8]}")
    month = build_base(raw_trips(spark, SF_SMALL)).withColumn("partition_month", F.lit("2018-03-01").cast("date"))
    write_layer(month, path, "trips_base", range_bytes=50_000)
    ranges = []
    for file in glob.glob(f"{path}/layer_write_id=*/partition_month=*/*.parquet"):
        keys = pq.read_table(file, columns=["company", "taxi_id"]).to_pylist()
        ordered = [(r["company"] or "", r["taxi_id"] or "") for r in keys]
        ranges.append((min(ordered), max(ordered)))
    ranges.sort()
    assert len(ranges) > 2
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_one_firm_with_all_rows_of_a_month_is_split(spark, scratch):
    """Equal clustering keys do not keep rows together; the session's shuffle partitions do not matter."""
    import pyarrow.parquet as pq

    from cabflow.operators.layers import build_base
    from cabflow.sources.layers import range_count, write_layer

    path = os.path.join(scratch, f"hot-{uuid.uuid4().hex[:8]}")
    base = build_base(raw_trips(spark, SF_SMALL))
    same = {"partition_month": F.lit("2018-03-01").cast("date"), "company": F.lit("Alpha"), "taxi_id": F.lit("T1"), "payment_type": F.lit("Cash"), "pickup_community_area": F.lit(8)}
    hot = base.withColumns(same)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = set()
    for partitions in ("1", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        counts.add(range_count(hot, 40_000))
        if partitions == "1":
            write_layer(hot, path, "trips_base", range_bytes=40_000)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/layer_write_id=*/partition_month=*/*.parquet")]
    assert len(counts) == 1 and len(rows) == counts.pop() >= 5
    assert sum(rows) == hot.count() and max(rows) < 1.7 * sum(rows) / len(rows)


def test_range_count_follows_the_bytes(spark, paths):
    from cabflow.sources.layers import range_count

    base = read_layer(spark, paths["trips_base"], "trips_base", lo="2013-01-01")
    one = read_layer(spark, paths["trips_base"], "trips_base", lo="2018-03-01", hi="2018-03-01")
    assert range_count(base) == 1 and 50 < range_count(base, 5_000) < 10_000
    assert range_count(one, 5_000) < range_count(base, 5_000) / 20


def test_raw_files_of_unequal_schema(spark, scratch):
    """A column that only some files hold is carried, whichever file Spark looks at first."""
    from cabflow.sources import read_raw
    from cabflow.sources.fixture import land_raw

    path = os.path.join(scratch, f"unequal-{uuid.uuid4().hex[:8]}")
    land_raw(spark, SF_SMALL, f"{path}/plain")
    plain = spark.read.parquet(f"{path}/plain").coalesce(2)
    n = plain.count()
    for name, first, second in (
        ("a", plain, plain.withColumn("shift", F.lit("night"))),
        ("b", plain.withColumn("shift", F.lit("night")), plain.drop("tolls")),
    ):
        first.write.parquet(f"{path}/{name}")
        second.write.mode("append").parquet(f"{path}/{name}")
        got = read_raw(spark, f"{path}/{name}")
        assert got.count() == 2 * n and got.where("shift = 'night'").count() == n
        assert {"shift", *plain.columns} == set(got.columns)
    assert read_raw(spark, f"{path}/b").where("tolls IS NULL").count() >= n
    # Timestamps without a time zone are read as well; another type in any file is an error.
    local = plain.withColumn("trip_start_timestamp", F.col("trip_start_timestamp").cast("timestamp_ntz"))
    local.write.parquet(f"{path}/times")
    assert read_raw(spark, f"{path}/times").exceptAll(local.select(read_raw(spark, f"{path}/times").columns)).count() == 0
    plain.write.parquet(f"{path}/types")
    plain.withColumn("fare", F.col("fare").cast("string")).write.mode("append").parquet(f"{path}/types")
    with pytest.raises(TypeError, match="different types"):
        read_raw(spark, f"{path}/types")


def test_raw_columns_are_all_carried(spark, scratch):
    from pyspark.sql import functions as F

    from cabflow.sources import read_raw
    from cabflow.sources.fixture import land_raw

    path = os.path.join(scratch, f"raw-{uuid.uuid4().hex[:8]}")
    land_raw(spark, SF_SMALL, f"{path}/plain")
    wide = spark.read.parquet(f"{path}/plain").withColumn("shift", F.lit("night"))
    wide.drop("tolls").write.parquet(f"{path}/wide")
    got = read_raw(spark, f"{path}/wide")
    assert {"shift", "pickup_latitude", "dropoff_longitude", "tolls"} <= set(got.columns)
    assert got.where("tolls IS NOT NULL").count() == 0
    wide.withColumn("fare", F.col("fare").cast("string")).write.parquet(f"{path}/wrong")
    with pytest.raises(TypeError, match="fare"):
        read_raw(spark, f"{path}/wrong")


def test_views_of_guarded_layers_need_a_bound(spark, paths):
    from cabflow.plans.refresh import register_views

    with pytest.raises(PartitionFilterRequired):
        register_views(spark, paths)


def test_layers_as_sql_views(spark, paths):
    from cabflow.plans.refresh import register_views

    register_views(spark, paths, lo="2013-01-01")
    sql = spark.sql(
        """
        SELECT is_airport_trip, SUM(trip_count) AS trip_count FROM mart_geo_flows GROUP BY 1
        """
    )
    report = QUERIES["report_airport_segments"](spark, SF_SMALL).groupBy(F.col("segment") != "Non-Airport").sum("trip_count")
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, report.collect()))
    pruned = spark.sql("SELECT COUNT(*) FROM v_trips_enriched WHERE partition_month >= DATE'2020-01-01' AND NOT has_geo")
    assert "PartitionFilters: [isnotnull(partition_month" in plan_text(pruned)
    expected = read_layer(spark, paths["trips_base"], "trips_base", lo="2020-01-01").filter(
        "pickup_community_area IS NULL OR dropoff_community_area IS NULL"
    ).count()
    assert pruned.first()[0] == expected
