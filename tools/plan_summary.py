"""Summarise the physical plans of registered queries.

    python tools/plan_summary.py [--sf DIR] [names...]

For each query: exchanges (and what they partition on), join strategies,
sorts, windows, Python stages, and every parquet scan with its pushed
filters and read schema.  Builders that run jobs while building (cube
checkpoints, model fits) do so before the plan is printed.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.plans.catalog import all_queries  # noqa: E402
from tidepanel.session import local_session  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "ReusedExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Sort [", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Generate", "FlatMapGroupsInPandas",
         "MapInPandas", "FileScan parquet", "Scan ExistingRDD", "Filter"]


def summarise(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = {n.strip(" ["): plan.count(n) for n in NODES if plan.count(n)}
    out = [", ".join(f"{k}={v}" for k, v in counts.items())]
    for m in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        out.append(f"  shuffle on {re.sub(r'#\\d+L?', '', m.group(1))}")
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        line = m.group(0)
        table = re.search(r"/([a-z]+)\.parquet", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        schema = re.search(r"ReadSchema: struct<([^>]*)>", line)
        out.append(f"  scan {table.group(1) if table else '?'}: read [{schema.group(1) if schema else ''}]"
                   f" pushed [{re.sub(r'#\\d+L?', '', pushed.group(1)) if pushed else ''}]")
    return "\n".join(out)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    qs = all_queries()
    for n in args.names or list(qs):
        df = qs[n].build(spark, args.sf)
        print(f"### {n}\n{summarise(df)}\n")
    spark.stop()


if __name__ == "__main__":
    main()
