"""Benchmark: the materialised refresh at one scale factor.

Steps (each timed):

1. ``land_raw``  — derive raw trips from ``lineitem`` and land them as Parquet
   (the raw source the analysis starts from);
2. ``trips_base``, ``trips_silver``, the three marts — written layers;
3. every audit and report, run on the written layers (``collect``; the
   independent result sets run as concurrent jobs, as do the three marts).

4. every registered query of the analysis, lazily from ``lineitem`` to its
   last row, one at a time (``registered``; the ``written_…`` queries run
   the layers of step 2 and are left out).

Prints one JSON line. ``value`` is the wall time of steps 2-3 (the
analysis itself); ``land_raw`` and ``registered`` are reported alongside.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ROOT: folder for the layers (default: a fresh temporary folder),
BENCH_REGISTERED=0: leave out step 4.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cabflow.plans.queries import QUERIES  # noqa: E402
from cabflow.plans.refresh import build_layers, collect_all, layer_reports  # noqa: E402
from cabflow.session import build_session, shared_dir  # noqa: E402
from cabflow.sources import read_raw  # noqa: E402
from cabflow.sources.fixture import land_raw  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = os.environ.get("BENCH_ROOT") or tempfile.mkdtemp(prefix="cabflow-bench-")
    spark = build_session(
        f"local[{cpus}]",
        app="cabflow-bench",
        shuffle_partitions=cpus,
        scratch=scratch,
        extra={"spark.ui.showConsoleProgress": "false"},
    )
    root = f"{shared_dir(spark).rstrip('/')}/warehouse-{int(time.time())}"

    timings: dict[str, float] = {}
    start = time.perf_counter()
    land_raw(spark, sf_dir, f"{root}/raw")
    timings["land_raw"] = round(time.perf_counter() - start, 3)

    analysis_start = time.perf_counter()
    raw = read_raw(spark, f"{root}/raw")
    paths = build_layers(spark, raw, root, timings)
    start = time.perf_counter()
    results = collect_all(layer_reports(spark, paths), timings)
    timings["audits_and_reports"] = round(time.perf_counter() - start, 3)
    rows = {name: len(r) for name, r in results.items()}
    total = round(time.perf_counter() - analysis_start, 3)

    registered: dict[str, float] = {}

    for name, query in QUERIES.items() if os.environ.get("BENCH_REGISTERED", "1") != "0" else ():
        if not name.startswith("written_"):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            registered[name] = round(time.perf_counter() - start, 3)
    registered["sum"] = round(sum(registered.values()), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "refresh_and_reports_wall",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "registered": registered,
                "rows": rows,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
