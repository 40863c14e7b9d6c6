"""Summarise the physical plan of each headline query: shuffles, join strategies,
top-k limits, Python stages and the columns each scan reads. Writes markdown to stdout.

usage: python scripts/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import HEADLINE  # noqa: E402
from docflow.plans.registry import load_all  # noqa: E402
from docflow.session import build_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange RoundRobin", "Exchange SinglePartition",
       "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
       "WindowGroupLimit", "TakeOrderedAndProject", "HashAggregate", "ObjectHashAggregate",
       "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Generate"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("plan-summary")
    qs = load_all()
    print("# Physical plan summary (initial plans, before AQE re-planning)\n")
    print(f"Data: `{sf}`. Counts are operator occurrences in the plan text; `ReadSchema` lists"
          " the columns each parquet scan reads (column pruning).\n")
    for name in HEADLINE:
        plan = qs[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {op: len(re.findall(re.escape(op), plan)) for op in OPS}
        scans = sorted(set(re.findall(r"ReadSchema: (struct<\S*>)", plan)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)) - {"[]"})
        used = ", ".join(f"{op} ×{n}" for op, n in counts.items() if n)
        print(f"## {name}\n\n- operators: {used}\n- scans: {'; '.join(scans)}")
        if pushed:
            print(f"- pushed filters: {'; '.join(pushed)}")
        print()


if __name__ == "__main__":
    main()
