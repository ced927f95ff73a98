"""Checks: compare a registered query with its DuckDB oracle; inspect plans.

``compare`` collects both results (test sizes only), sorts the columns by
name and the rows by value, and requires exact equality — doubles
included, which is what the exact sums and decimal rounding buy.
"""

from __future__ import annotations

import datetime as _dt
import math
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem",)


def duckdb_connect(sf_dir: str, tables: tuple[str, ...] = TABLES):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(float(v)))
    if isinstance(v, Decimal):
        return (1, repr(float(v)))
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (1, repr(float(v)) if abs(v) < 2**53 else str(v))
    if isinstance(v, _dt.datetime):
        return (3, v.replace(tzinfo=None).isoformat())
    if isinstance(v, _dt.date):
        return (3, v.isoformat())
    return (4, str(v))


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, name: str, sf_dir: str, con=None) -> dict:
    """Run query ``name`` in Spark and DuckDB on ``sf_dir``; report differences."""
    from cabflow.plans.oracle import oracle_sql
    from cabflow.plans.queries import QUERIES

    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duckdb_connect(sf_dir)
    cur = con.execute(oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    result = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
    }
    if result["columns_match"]:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        result["values_match"] = a == b
        if a != b:
            sa, sb = set(a), set(b)
            result["only_spark"] = sorted(sa - sb)[:3]
            result["only_oracle"] = sorted(sb - sa)[:3]
    else:
        result["values_match"] = False
        result["spark_columns"] = s_cols
        result["oracle_columns"] = d_cols
    result["ok"] = result["values_match"] and result["spark_rows"] == result["oracle_rows"]
    return result


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (``explain`` prints; this returns)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def _plan_nodes(node):
    """All physical nodes of an executed plan, through adaptive query stages."""
    yield node
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _plan_nodes(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _plan_nodes(node.plan())
    children = node.children()
    for i in range(children.size()):
        yield from _plan_nodes(children.apply(i))


def scans(df: DataFrame) -> list[int]:
    """Rows that each file scan read which ``df`` executed, those of scalar subqueries included.

    What is reused counts once, where it was computed. Call after an action on ``df``.
    """
    found: dict[int, int] = {}

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name.startswith("Reused"):
            return
        if name == "FileSourceScanExec":
            found[node.hashCode() if node.metrics().isEmpty() else node.metrics().get("numOutputRows").get().id()] = int(
                node.metrics().get("numOutputRows").get().value()
            )
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        for children in (node.children(), node.subqueries()):
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return list(found.values())


def shuffle_records(df: DataFrame) -> list[tuple[str, int]]:
    """(partitioning, records written) of every shuffle ``df`` executed.

    Call after an action on ``df`` itself (e.g. ``df.collect()``).
    """
    out = []
    for node in _plan_nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            written = node.metrics().get("shuffleRecordsWritten").get().value()
            out.append((node.outputPartitioning().toString(), int(written)))
    return out
