"""bench.py prints one JSON line with the agreed keys."""

import json
import os
import subprocess
import sys


def test_bench_json_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py"), "correlation_matrix"],
                         capture_output=True, text=True, env=env, timeout=600, cwd="/tmp")
    lines = [ln for ln in out.stdout.splitlines() if ln.startswith("{")]
    assert len(lines) == 1, out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert set(rec) >= {"metric", "value", "unit", "queries", "sf"}
    assert rec["unit"] == "sec" and rec["sf"] == 0.001 and rec["value"] > 0
    assert list(rec["queries"]) == ["correlation_matrix"]
