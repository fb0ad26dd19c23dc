"""Operator counts of every registered query's executed plan: Python stages,
exchanges, broadcasts, sort-merge / nested-loop joins, Cartesian products.

    python tests/plan_summary.py [sf_dir]
"""
import re
import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from quarry.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = get_spark("local[8]", shuffle_partitions=16)
for name, fn in E.queries().items():
    p = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    print(f"{name:22s} python={p.count('ArrowEvalPython') + p.count('MapInPandas')} "
          f"exchanges={len(re.findall(r'Exchange (hash|RoundRobin|SinglePartition|range)', p))} "
          f"broadcasts={p.count('BroadcastExchange')} smj={p.count('SortMergeJoin')} "
          f"bnlj={p.count('BroadcastNestedLoopJoin')} cartesian={p.count('CartesianProduct')} "
          f"sort_agg={p.count('SortAggregate')}")
