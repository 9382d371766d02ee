"""Print the formatted physical plan of registered queries, with a short summary of the
things that matter at scale: scans (pushed filters, read schema), exchanges, broadcasts,
Python evaluation nodes and window nodes.

Usage: python scripts/show_plans.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retention.plans.registry import QUERIES  # noqa: E402
from retention.session import get_session  # noqa: E402


def summary(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single_partition": plan.count("SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "scans": re.findall(r"ReadSchema: (struct<[^>]*>)", plan),
        "pushed": sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan))),
    }


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    names = [a for a in args if not os.path.isdir(a)] or ["customers", "churn_by_clv", "stratified_split",
                                                          "score_batch", "auc", "top_factors"]
    spark = get_session("local[4]")
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {n}: {summary(plan)}")
        if os.environ.get("FULL"):
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
