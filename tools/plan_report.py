"""Per-key physical plan inventory as it would run at scale.

Statistics-based broadcasts are switched off (at 100 TB the dimension tables
are far above any threshold), so the plans show the joins a cluster would
run; the only broadcasts left are the explicit, size-bounded ones. Prints a
Markdown table: file scans, exchanges, join strategies and the operators that
matter for scale.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from claimlens.plans.registry import ALL, run_any  # noqa: E402

from claimlens.session import build_session  # noqa: E402

FEATURES = [
    ("partial_", "partial aggregation"),
    ("TakeOrderedAndProject", "top-k per task"),
    ("WindowGroupLimit", "group limit before shuffle"),
    ("Generate", "generate (explode)"),
    ("Expand", "expand"),
]


def describe(plan: str) -> dict:
    lines = plan.splitlines()
    joins = []
    for ln in lines:
        m = re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)(?:\(skew=true\))? \[([^\]]*)\], \[[^\]]*\], (\w+)", ln)
        if m:
            key = re.sub(r"#\d+L?", "", m.group(2))
            joins.append(f"{ {'SortMergeJoin': 'SMJ', 'BroadcastHashJoin': 'BHJ', 'ShuffledHashJoin': 'SHJ'}[m.group(1)] } "
                         f"{m.group(3)} on {key}")
    feats = [label for token, label in FEATURES if token in plan]
    return {
        "scans": sum("FileScan parquet" in ln or "Range (" in ln for ln in lines),
        "exchanges": sum(("Exchange " in ln or ln.strip().startswith("+- Exchange")) and "Broadcast" not in ln
                         for ln in lines),
        "broadcasts": sum("BroadcastExchange" in ln for ln in lines),
        "joins": joins,
        "features": feats,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[4]", app_name="claimlens-plans", shuffle_partitions=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print("| key | scans | shuffles | broadcasts | joins | scale-relevant operators |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in ALL:
        df = run_any(spark, sf_dir, name)
        formatted = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        d = describe(formatted)
        print(f"| `{name}` | {d['scans']} | {d['exchanges']} | {d['broadcasts']} | "
              f"{'; '.join(d['joins']) or '—'} | {', '.join(d['features']) or '—'} |")
    spark.stop()


if __name__ == "__main__":
    main()
