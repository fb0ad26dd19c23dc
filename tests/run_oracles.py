"""Run every registered query against its DuckDB oracle (driver-style check).

    python tests/run_oracles.py [sf_dir] [name ...]
"""
import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from quarry.session import get_spark  # noqa: E402
from tests.oracle_check import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = get_spark("local[8]", shuffle_partitions=8)
con = duck(sf)
sqls = E.oracle_sql()
bad = 0
for name, fn in E.queries().items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sqls:
            r = compare(df, sqls[name], con)
        else:
            r = {"rows_spark": df.count(), "oracle": "rows-only"}
    except Exception as e:  # noqa: BLE001
        r = {"error": repr(e)[:800]}
    r["sec"] = round(time.time() - t, 2)
    ok = r.get("hash_match", "oracle" in r) and r.get("cols_match", True)
    bad += not ok
    print(("OK  " if ok else "BAD ") + name, json.dumps(r, default=str)[:1500], flush=True)
print("failures:", bad)
