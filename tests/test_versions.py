"""Versions of layers: whole switches, refused second writers, what readers see meanwhile."""

import glob
import os
import threading
import uuid
import warnings

import pytest
from pyspark.sql import functions as F

from cabflow.plans.refresh import build_layers, layer_reports, set_aside_trips
from cabflow.sources import ConcurrentWrite, RefreshInProgress, versions
from cabflow.sources.fixture import raw_trips
from cabflow.sources.layers import read_layer, write_layer

from conftest import SF_SMALL

MONTHS = ["2018-01-01", "2018-02-01", "2018-03-01"]


@pytest.fixture
def path(scratch):
    return os.path.join(scratch, f"versioned-{uuid.uuid4().hex[:8]}")


def mart(spark, tag, months=MONTHS, rows=40):
    """A geo mart whose rows all carry ``tag`` as their trip count."""
    of = F.element_at(F.array(*[F.lit(m).cast("date") for m in months]), (F.col("id") % len(months) + 1).cast("int"))
    return spark.range(rows).select(
        of.alias("month_start"),
        F.col("id").alias("pickup_community_area"),
        F.col("id").alias("dropoff_community_area"),
        F.lit(False).alias("is_airport_trip"),
        F.lit(tag).cast("long").alias("trip_count"),
    )


def seen(spark, path, **kw):
    """(tags, rows) of a read."""
    rows = read_layer(spark, path, "mart_geo_flows", **kw).select("trip_count").collect()
    return {r.trip_count for r in rows}, len(rows)


def writes(path):
    return glob.glob(f"{path}/{versions.WRITE}=*")


@pytest.mark.parametrize("where", ["commit", "put_new", "_rename_new"])
def test_a_failure_in_the_switch_leaves_the_old_layer(spark, path, monkeypatch, where):
    write_layer(mart(spark, 1), path, "mart_geo_flows")

    def fails(*args, **kw):
        raise OSError("the driver's connection is gone")

    with monkeypatch.context() as patched:
        patched.setattr(versions if where == "commit" else versions.Files, where, fails)
        with pytest.raises(OSError, match="gone"):
            write_layer(mart(spark, 2, months=MONTHS[:1]), path, "mart_geo_flows")
    assert seen(spark, path) == ({1}, 40)
    assert len(writes(path)) == 1  # what was written goes
    write_layer(mart(spark, 3, months=MONTHS[:1], rows=7), path, "mart_geo_flows")
    assert seen(spark, path) == ({3}, 7)


def test_a_driver_that_dies_before_the_commit_leaves_the_old_layer(spark, path, monkeypatch):
    write_layer(mart(spark, 1), path, "mart_geo_flows")

    class Died(BaseException):
        pass

    def dies(*args):
        raise Died

    with monkeypatch.context() as patched:
        patched.setattr(versions, "commit", dies)
        patched.setattr(versions, "discard", lambda *args: None)  # a dead driver cleans nothing up
        with pytest.raises(Died):
            write_layer(mart(spark, 2), path, "mart_geo_flows")
    assert seen(spark, path) == ({1}, 40) and len(writes(path)) == 2
    assert len(versions.vacuum(spark, path, orphans=True)) == 1
    assert seen(spark, path) == ({1}, 40) and len(writes(path)) == 1


def test_a_read_begun_before_the_switch_is_wholly_old(spark, path):
    write_layer(mart(spark, 1), path, "mart_geo_flows")
    before = read_layer(spark, path, "mart_geo_flows")
    write_layer(mart(spark, 2, rows=25), path, "mart_geo_flows")
    assert sorted({r.trip_count for r in before.collect()}) == [1] and before.count() == 40
    assert seen(spark, path) == ({2}, 25)
    assert seen(spark, path, version=1) == ({1}, 40)


def test_readers_during_switches_see_one_version_each(spark, path):
    write_layer(mart(spark, 1), path, "mart_geo_flows")
    stop, mixed, reads = threading.Event(), [], []

    def read():
        while not stop.is_set():
            tags, rows = seen(spark, path)
            reads.append(rows)
            if len(tags) != 1 or rows != 40 + 3 * (min(tags) - 1):
                mixed.append((tags, rows))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        # One switch at a time: a version stays readable until the second commit after it.
        for tag in (2, 3, 4):
            n = len(reads)
            write_layer(mart(spark, tag, rows=40 + 3 * (tag - 1)), path, "mart_geo_flows")
            while len(reads) < n + 2 and reader.is_alive():
                pass
    finally:
        stop.set()
        reader.join()
    assert not mixed and len(reads) >= 6


def test_the_second_of_two_writers_is_refused(spark, path):
    write_layer(mart(spark, 1), path, "mart_geo_flows")

    def other_first(df):  # runs after the first writer has read its version
        write_layer(mart(spark, 2), path, "mart_geo_flows")
        return df

    with pytest.raises(ConcurrentWrite):
        write_layer(mart(spark, 3), path, "mart_geo_flows", derive=other_first)
    assert seen(spark, path) == ({2}, 40)
    assert len(writes(path)) == 2  # versions 1 and 2


def test_months_of_several_writes_and_old_data(spark, path):
    write_layer(mart(spark, 1), path, "mart_geo_flows")
    for tag in (2, 3, 4):
        one = mart(spark, tag, months=MONTHS[1:2], rows=5).withColumn("extra", F.lit("x"))
        write_layer(one, path, "mart_geo_flows", months=(MONTHS[1], MONTHS[1]))
    rows = read_layer(spark, path, "mart_geo_flows").collect()
    assert sorted({(str(r.month_start), r.trip_count, r.extra) for r in rows}, key=str) == [
        (MONTHS[0], 1, None), (MONTHS[1], 4, "x"), (MONTHS[2], 1, None)
    ]
    # Of the middle month the last two writes stay, of the others the first.
    assert len(glob.glob(f"{path}/{versions.WRITE}=*/month_start={MONTHS[1]}")) == 2
    assert len(glob.glob(f"{path}/{versions.WRITE}=*/month_start={MONTHS[0]}")) == 1
    with pytest.raises(TypeError, match="trip_count"):
        changed = mart(spark, 5, months=MONTHS[:1]).withColumn("trip_count", F.lit("five"))
        write_layer(changed, path, "mart_geo_flows", months=(MONTHS[0], MONTHS[0]))
    write_layer(mart(spark, 6, rows=0), path, "mart_geo_flows")
    assert seen(spark, path) == (set(), 0)
    with pytest.raises(FileNotFoundError):
        read_layer(spark, path + "-none", "mart_geo_flows")


def test_a_second_refresh_is_refused(spark, scratch):
    root = os.path.join(scratch, f"locked-{uuid.uuid4().hex[:8]}")
    raw = raw_trips(spark, SF_SMALL)
    with versions.refresh_lock(spark, root):
        with pytest.raises(RefreshInProgress, match="started"):
            build_layers(spark, raw, root, only={"trips_base"})
    build_layers(spark, raw, root, only={"trips_base"})  # the lock is gone again
    with versions.refresh_lock(spark, root):  # of a driver that died
        build_layers(spark, raw, root, only={"trips_base"}, break_lock=True)
        assert not os.path.exists(f"{root}/{versions.LOCK}")
    assert versions.manifest(spark, f"{root}/trips_base").version == 2


def test_an_infinite_fare_is_named_and_stops_nothing(spark, scratch):
    root, clean = (os.path.join(scratch, f"infinite-{uuid.uuid4().hex[:8]}") for _ in range(2))
    raw = raw_trips(spark, SF_SMALL)
    silver = build_layers(spark, raw, clean)["trips_silver"]
    trip = read_layer(spark, silver, "trips_silver", lo="2018-01-01").orderBy("unique_key").first()
    bad = F.col("unique_key") == trip.unique_key
    with pytest.warns(UserWarning, match=f"trip {trip.unique_key} of {trip.partition_month}: fare is inf"):
        paths = build_layers(spark, raw.withColumn("fare", F.when(bad, F.lit(float("inf"))).otherwise(F.col("fare"))), root)
    assert set_aside_trips(spark, paths) == [f"trip {trip.unique_key} of {trip.partition_month}: fare is inf"]
    assert set_aside_trips(spark, {"trips_set_aside": f"{clean}/trips_set_aside"}) == []
    total = lambda r: read_layer(spark, f"{r}/mart_time_analysis", "mart_time_analysis", lo="2013-01-01").agg(F.sum("trip_count")).first()[0]
    assert total(root) == total(clean) - 1
    assert all(df.count() for df in layer_reports(spark, paths).values())
    assert read_layer(spark, paths["trips_silver"], "trips_silver", lo="2013-01-01").where("fare = double('inf')").count() == 1


def test_no_warning_without_such_trips(spark, scratch):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        build_layers(spark, raw_trips(spark, SF_SMALL), os.path.join(scratch, f"quiet-{uuid.uuid4().hex[:8]}"), only={"trips_base", "trips_silver", "trips_set_aside"})
