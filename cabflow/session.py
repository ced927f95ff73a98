"""Session settings the library relies on.

On a cluster the session comes from the platform; ``tune_session`` only
applies the SQL settings the results depend on (UTC) plus the adaptive
execution switches that matter at scale. ``build_session`` is for local
runs (tests, bench).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that are safe to apply to any session at runtime.
RUNTIME_CONF = {
    # Calendar functions (DATE, EXTRACT) are evaluated in UTC, as in the source SQL.
    "spark.sql.session.timeZone": "UTC",
    # Adaptive execution: coalesce small shuffle partitions, split skewed ones,
    # and size the files written after a REBALANCE.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A task derives, sorts and cuts down what it reads before it shuffles it, and
    # trips in memory are some twenty times their bytes in a file: of a larger
    # piece the sort would go to disk.
    "spark.sql.files.maxPartitionBytes": "24m",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a
    # fused stage larger than that would run interpreted. Above the limit
    # Spark falls back to split (per-expression) code generation instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    master: str | None = None,
    app: str = "cabflow",
    shuffle_partitions: int | None = None,
    scratch: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session: UI off, UTC, AQE on.

    ``scratch`` becomes ``spark.checkpoint.dir`` only when the session does
    not name one already (tests and bench pass a fresh ``mktemp -d``).
    """
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    cpus = os.cpu_count() or 8
    builder = builder.config(
        "spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)
    )
    builder = builder.config("spark.driver.memory", "16g")
    # Small local data: let AQE keep several coalesced partitions so that
    # month-partitioned writes of small layers use every core (a cluster's
    # partitions are far above either floor, so this only matters locally).
    builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    # A local file system lists a few hundred month folders faster on the
    # driver than through a distributed listing job (which pays off against
    # an object store on a cluster).
    builder = builder.config("spark.sql.sources.parallelPartitionDiscovery.threshold", "1024")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    if scratch and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", scratch)
        spark.sparkContext.setCheckpointDir(scratch)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """``shared_dir``, or for a session in one process that names none a temporary folder of its own."""
    try:
        return shared_dir(spark)
    except RuntimeError:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cabflow-"))
        return shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide shared folder named by ``spark.checkpoint.dir``.

    Materialised layers and lineage cuts go there, never to a machine-local
    temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; the cluster must name a shared folder"
        )
    return path
