"""cabflow: a Spark-native trip-analytics library.

Raw taxi trips are refined layer by layer — base (month-partitioned),
enriched (derived measures and flags), silver (validated, deduplicated) —
into three additive data marts (company performance, time, geographic
flows) that feed small business reports. Every stage is a pure
``DataFrame -> DataFrame`` function built from built-in column functions,
so Catalyst sees the whole plan and keeps it inside whole-stage codegen.

Sub-packages:

* ``functions`` – Column -> Column helpers (safe division, exact sums,
  engine-stable rounding) and the named trip derivations.
* ``sources``   – the raw schema, the test-table adapter and the layered
  Parquet writer/reader (month partitions, clustering, scan guard).
* ``operators`` – layers, audits, marts and reports.
* ``plans``     – the query registry, the DuckDB oracle text, the
  materialised refresh of all layers and plan checks.
"""

from cabflow.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
