"""Layered Parquet storage: versions, month partitions, clustered files, guarded reads.

* ``write_layer`` — ``CREATE OR REPLACE TABLE … PARTITION BY month CLUSTER BY …``:
  the new data are written beside the layer's and take their place by the
  commit of one manifest (``cabflow.sources.versions``): a reader sees the
  old layer or the new one, and a job that fails anywhere leaves the old.
* Trip layers are range-partitioned and sorted by (month, clustering keys),
  so the files of a month hold disjoint key ranges and pushed filters skip
  files and row groups by their statistics. The number of ranges follows the
  bytes that are laid out, and ``unique_key`` comes last in the range, so a
  month, a firm or a taxi too large for one file is split. The marts and the
  audit profile, whose months are small, are dealt out by month instead,
  which spares the sampling pass that ranges need. Rows read from a layer that
  is laid out already may keep its ranges (``in_place``): they are sorted and
  written by the tasks that read them.
* ``read_layer`` — ``require_partition_filter``: reading a guarded layer
  without a month range raises; with one, only the folders of those months
  are listed, and the range is a ``PartitionFilters`` entry as well.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cabflow.sources import versions
from cabflow.sources.schema import (
    CLUSTER_KEYS,
    GUARDED_LAYERS,
    MART_PARTITION,
    PARTITION_COLUMNS,
    PROFILE_PARTITION,
    RANGED_LAYERS,
    TRIP_PARTITION,
)


def as_date(value: str | _dt.date) -> _dt.date:
    return value if isinstance(value, _dt.date) else _dt.date.fromisoformat(value)


def partition_column(layer: str) -> str:
    if layer in PARTITION_COLUMNS:
        return PARTITION_COLUMNS[layer]
    return TRIP_PARTITION if layer.startswith("trips_") else MART_PARTITION


class PartitionFilterRequired(ValueError):
    """A guarded layer was read without a month range."""


#: Bytes of input (as Spark's statistics have them: files, mostly) that a range gets.
#: The rows in memory are about six times as large, and a task sorts its range there.
RANGE_BYTES = 48 << 20
#: Statistics above this mean that Spark knows no size.
NO_SIZE = 1 << 60
#: A layer smaller than one range a core is spread over the cores in ranges of this size at least.
SMALLEST_RANGE_BYTES = 4 << 20
#: Last key of the ranges: splits rows that agree in all clustering keys.
TIE = "unique_key"


def range_count(df: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges for laying out ``df``: by its bytes, whatever the session's shuffle partitions are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > NO_SIZE:
        return cores
    return max(1, min(cores, -(-size // min(range_bytes, SMALLEST_RANGE_BYTES))), -(-size // range_bytes))


def _merged(old: StructType, new: StructType) -> StructType:
    """Columns of a layer of which only some months are written anew (the month last)."""
    types = {f.name: f.dataType for f in old.fields}
    other = [f.name for f in new.fields if types.get(f.name, f.dataType) != f.dataType]
    if other:
        raise TypeError(f"{', '.join(other)}: of another type than in the months that stay; rewrite the whole layer")
    return StructType([*new.fields[:-1], *[f for f in old.fields if f.name not in new.names], new.fields[-1]])


def write_layer(
    df: DataFrame,
    path: str,
    layer: str,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    cluster: dict[str, Column] | None = None,
    months: tuple[str, str] | None = None,
    range_bytes: int = RANGE_BYTES,
    in_place: DataFrame | None = None,
) -> versions.Manifest:
    """Write ``df`` as layer ``layer`` under ``path``, replacing it, or its ``months`` (lo, hi) only.

    The layer then holds exactly the rows of ``df`` in those months: a month
    without rows in ``df`` goes. ``derive`` adds columns after the exchange,
    so columns that are functions of others are computed where they are
    written instead of being shuffled; ``cluster`` gives the expressions of
    clustering keys that only ``derive`` adds. ``in_place`` are more rows, of
    the columns of ``df``, that are not moved: their files hold the ranges of
    the layer they are read from, and the rows of ``df``, the fewer, are dealt
    out by month beside them. Returns the version put in place; raises
    ``ConcurrentWrite`` if another one was meanwhile.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    parent = versions.manifest(spark, path)
    month = partition_column(layer)
    wanted = CLUSTER_KEYS.get(layer, [])
    if in_place is not None:
        laid_out = in_place.unionByName(df.hint("rebalance", month))
    elif layer in RANGED_LAYERS:
        ranges = [(cluster or {}).get(k, F.col(k)) for k in wanted if k in df.columns or k in (cluster or {})]
        tie = [F.col(TIE)] if TIE in df.columns else []
        laid_out = df.repartitionByRange(range_count(df, range_bytes), F.col(month), *ranges, *tie)
    else:
        laid_out = df.hint("rebalance", month)
    if derive is not None:
        laid_out = derive(laid_out)
    keys = [k for k in wanted if k in laid_out.columns]
    bounds = None if months is None else [str(_bound(layer)(m)) for m in months]
    stay = {} if parent is None or bounds is None else {m: w for m, w in parent.months.items() if not bounds[0] <= m <= bounds[1]}
    schema = StructType([f for f in laid_out.schema.fields if f.name != month] + [laid_out.schema[month]])
    schema = _merged(parent.schema, schema) if stay else schema
    write = f"w{uuid.uuid4().hex}"
    try:
        rows = laid_out.sortWithinPartitions(month, *keys)
        rows.write.option("compression", "zstd").partitionBy(month).parquet(f"{path}/{versions.WRITE}={write}")
        fresh = {m: write for m in versions.written_months(spark, path, write, month)}
        new = versions.Manifest((parent.version if parent else 0) + 1, month, schema, {**stay, **fresh})
        versions.commit(spark, path, parent, new)
    except BaseException:
        versions.discard(spark, path, write)
        raise
    versions.vacuum(spark, path)
    return new


def _bound(layer: str) -> Callable[[str | _dt.date], object]:
    """A yearly partitioned layer is bounded by the years of the months."""
    return (lambda d: as_date(d).year) if partition_column(layer) == PROFILE_PARTITION else as_date


def read_layer(
    spark: SparkSession,
    path: str,
    layer: str,
    lo: str | _dt.date | None = None,
    hi: str | _dt.date | None = None,
    version: int | None = None,
) -> DataFrame:
    """Read a written layer, restricted to months in ``[lo, hi]`` (inclusive).

    Guarded layers need at least one bound, as the source tables refuse
    unbounded scans. The result stays with the version that is newest now
    (or ``version``), whatever is written later.
    """
    path, month = path.rstrip("/"), partition_column(layer)
    if GUARDED_LAYERS.get(layer, False) and lo is None and hi is None:
        raise PartitionFilterRequired(f"{layer}: pass lo/hi to bound {month}")
    held = versions.manifest(spark, path, version)
    if held is None:
        raise FileNotFoundError(f"{path} holds no {'version' if version is None else f'version {version}'} of {layer}")
    bound = _bound(layer)
    low, high = (None if b is None else str(bound(b)) for b in (lo, hi))
    folders = [held.folder(path, m) for m in sorted(held.months) if (low is None or m >= low) and (high is None or m <= high)]
    if not folders:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields])
    schema = StructType([*held.schema.fields, StructField(versions.WRITE, StringType())])
    df = spark.read.schema(schema).option("basePath", path).parquet(*folders).drop(versions.WRITE)
    if lo is not None:
        df = df.filter(F.col(month) >= F.lit(bound(lo)))
    if hi is not None:
        df = df.filter(F.col(month) <= F.lit(bound(hi)))
    return df
