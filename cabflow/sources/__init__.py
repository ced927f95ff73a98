"""Sources and sinks: raw schema, test-table adapter, layered Parquet I/O."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from cabflow.sources.fixture import raw_trips, trips_from_lineitem
from cabflow.sources.layers import PartitionFilterRequired, read_layer, write_layer
from cabflow.sources.schema import RAW_SCHEMA
from cabflow.sources.versions import ConcurrentWrite, RefreshInProgress

__all__ = [
    "raw_trips",
    "trips_from_lineitem",
    "read_layer",
    "write_layer",
    "PartitionFilterRequired",
    "ConcurrentWrite",
    "RefreshInProgress",
    "RAW_SCHEMA",
    "raw_columns",
    "read_raw",
]


def raw_columns(spark, path: str) -> StructType:
    """Every column that any raw file holds: the union of all footers, read by one distributed job.

    Files that differ in a column's type are an error, and so is a declared
    column of another type; timestamps may be with or without a time zone,
    but alike in all files.
    """
    try:
        held = spark.read.option("mergeSchema", "true").parquet(path).schema
    except (PySparkException, Py4JJavaError) as problem:
        if "CANNOT_MERGE" not in str(problem):
            raise
        raise TypeError(f"{path}: files hold a column in different types: {str(problem)[:2000]}") from problem
    types = {f.name: f.dataType for f in held.fields}
    wrong = [
        f"{f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in RAW_SCHEMA.fields
        if types.get(f.name, f.dataType) != f.dataType
        and not (isinstance(f.dataType, TimestampType) and isinstance(types[f.name], TimestampNTZType))
    ]
    if wrong:
        raise TypeError(f"{path}: {'; '.join(wrong)}")
    return held


def read_raw(spark, path: str):
    """Scan raw trip files: the declared columns, then any others that any of the files holds.

    A column that a file lacks is NULL in its rows, a declared one that all
    files lack is NULL throughout; see ``raw_columns`` for the types.
    """
    held = raw_columns(spark, path)
    raw = spark.read.schema(held).parquet(path)
    declared = [F.col(f.name) if f.name in held.names else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]
    others = [F.col(f"`{name}`") for name in held.names if name not in RAW_SCHEMA.names]
    return raw.select(*declared, *others)
