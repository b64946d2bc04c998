"""Summarise the executed physical plans of the library's queries (dev tool).

Usage: python tests/plan_summary.py [sf_dir] > PLANS.md (training queries are left out)
Counts, per query, the shuffles, broadcasts, sort-merge joins, nested-loop
joins, scans of the biggest table, codegen stages and windows in the final
adaptive plan, after running the query once.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

def summarize(plan: str) -> dict:
    final = plan.split("+- == Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "reused": final.count("ReusedExchange"),
        "smj": final.count("SortMergeJoin"),
        "bnlj": final.count("BroadcastNestedLoopJoin"),
        "lineitem_scans": len(re.findall(r"FileScan parquet [^\n]*lineitem", final)),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", final))),
        "windows": len(re.findall(r"\bWindow\b", final)),
        "take_ordered": final.count("TakeOrderedAndProject"),
    }


def main() -> None:
    from inspectkit.plans.catalog import all_queries
    from inspectkit.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=8)
    qs = all_queries()
    print(f"# Executed plan shapes ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `python tests/plan_summary.py`. Counts are taken from the final adaptive plan after one run."
          " `lineitem_scans` counts scans of the largest table (the fact is the 4-way star join); `broadcasts`"
          " are the dimension tables AQE broadcasts by measured size plus explicit 1-row/parameter-bounded"
          " broadcasts. A query that writes an intermediate table shows the plan after it.\n")
    cols = ["shuffles", "broadcasts", "reused", "smj", "bnlj", "lineitem_scans", "windows",
            "take_ordered"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    slow = ("train_defect_classifier", "feature_importance", "score_defects", "stream_score_defects")  # their plan is the training's
    for name in sorted(set(qs) - set(slow)):
        df = qs[name].fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    f = qs["filter_state"].fn(spark, sf)
    plan = f._jdf.queryExecution().executedPlan().toString()
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))
    print("\n`filter_state` pushed filters per scan:\n")
    for p in pushed:
        print(f"- `{p}`")


if __name__ == "__main__":
    main()
