"""bench.py prints exactly one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEATS="1",
               BENCH_ONLY="count_by,top_k")
    out = subprocess.run([sys.executable, "bench.py"], cwd=REPO, env=env, capture_output=True, text=True,
                         timeout=300, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    result = json.loads(out[0])
    assert result["metric"] and result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"count_by", "top_k"}
    assert result["value"] == round(sum(result["queries"].values()), 3)
