"""Condensed physical plans of the key queries (operator tree, joins, pushed filters and read
schema of the deal scan), over a deal table stored as Parquet so scan pushdown is visible.
Usage: python tools/show_plans.py [sf_dir] > docs/PLANS.md"""
from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dealflow.plans.context import Review  # noqa: E402
from dealflow.plans.registry import OPERATORS  # noqa: E402
from dealflow.session import local_session  # noqa: E402
from dealflow.sources import fixtures  # noqa: E402

KEYS = ["dim_funnel_market", "funnel_grouping_sets", "historical_snapshots", "open_pipeline_full",
        "pod_detail", "forecast_windows", "top_red", "snapshot_sync", "market_scorecard"]
NODE = re.compile(r"^((?:[ :]*(?:\+-|:-) )?)([A-Z][A-Za-z]+)")


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        m = NODE.match(line)
        if not m or (out and not m.group(1)):
            continue
        indent, name = m.group(1), m.group(2)
        extra = ""
        if "Join" in name:
            extra = " " + " ".join(w.strip(",") for w in line.split() if w.strip(",") in (
                "Inner", "LeftOuter", "LeftSemi", "LeftAnti", "BuildRight", "BuildLeft"))
        elif name == "FileScan" and "PushedFilters" in line:
            pushed = line.split("PushedFilters: ")[1].split("], ")[0] + "]"
            schema = line.split("ReadSchema: ")[1]
            extra = f" {line.split('Location:')[0].split('[')[0].split()[-1]} pushed={pushed} read={schema}"
        elif name in ("HashAggregate", "SortAggregate") and "partial_" in line:
            extra = " (partial)"
        elif name == "Exchange":
            extra = " " + line.split("Exchange ")[1].split("(")[0].split(",")[0]
        out.append(f"{indent}{name}{extra}")
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    path = os.path.join(tempfile.mkdtemp(prefix="dealflow-plans-"), "deals")
    fixtures.deals(spark, sf_dir).write.parquet(path)
    r = Review(spark, spark.read.parquet(path), fixtures.owners(spark, sf_dir), fixtures.sentiment(spark, sf_dir))
    print("# Physical plans of key queries\n")
    print(f"Generated by `tools/show_plans.py` over a deal table stored as Parquet ({sf_dir}), AQE on\n"
          "(initial plans; AQE may still turn shuffle joins of small measured sides into broadcasts).\n")
    for k in KEYS:
        df = OPERATORS[k](r)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {k}\n\n```")
        print("\n".join(condensed(plan)))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv)
