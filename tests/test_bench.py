"""bench.py prints exactly one JSON line with the expected shape."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": SF_SMALL, "BENCH_CPUS": "4", "BENCH_REGISTERED": "0"}
    proc = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        capture_output=True, text=True, env=env, timeout=900, check=True,
    )
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001 and result["value"] > 0
    assert {"trips_base", "trips_silver", "marts", "report_airport_segments"} <= set(result["queries"])
    assert result["rows"]["report_airport_segments"] == 5
