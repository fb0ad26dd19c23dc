import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line(tmp):
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4")
    r = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=tmp, env=env,
                       capture_output=True, text=True, timeout=900)
    lines = [x for x in r.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, r.stdout[-2000:] + r.stderr[-2000:]
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["value"] > 0 and "failed" not in out
    assert all(v is not None for v in out["queries"].values())
