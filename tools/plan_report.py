"""Summarise the physical plan of every registered query into PLANS.md.

    python tools/plan_report.py [sf_dir] > PLANS.md

Per query: hash shuffles, broadcasts, single-partition exchanges, window operators,
WindowGroupLimit, Python stages, and the filters pushed into parquet scans. The static
plan (AQE off) is shown, so broadcast decisions reflect the planner's size estimates at
this scale; at run time AQE re-plans joins by measured size.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "single": plan.count("Exchange SinglePartition"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "group_limit": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", plan)),
        "pushed": sorted({p for p in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)}),
    }


def main(argv) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from kanon.session import build_session
    from kanon.plans.catalog import load_all

    spark = build_session(master="local[8]", shuffle_partitions=16, app="kanon-plans")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    print("# Physical plan summary\n")
    print(f"Static plans (AQE off) at `{sf_dir}`, generated by `tools/plan_report.py`. Queries that write "
          "first (round trips, `debit_fold`) do so; the plan shown is that of the returned table.\n")
    print("| query | shuffles | broadcasts | single-partition | windows | group-limit | python | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in load_all()[0].items():
        try:
            plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            s = summarise(plan)
            pushed = "; ".join(p for p in s["pushed"] if "IsNotNull" not in p or "," in p)[:160]
            print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['single']} | {s['windows']} | "
                  f"{s['group_limit']} | {s['python']} | {pushed} |")
        except Exception as e:  # noqa: BLE001
            print(f"| `{name}` | error: {type(e).__name__} | | | | | | |")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
