"""Physical-plan summary of every registered query.

    python -m checks.plan_report [sf_dir] [name ...]

Per query: number of exchanges (shuffles), broadcast exchanges, sort-merge
joins, nested-loop / cartesian joins (should be 0), windows, and for each
Parquet scan the read schema and pushed filters.
"""

from __future__ import annotations

import re
import sys

SKIP = {"ml9_cv_logistic_folds", "ml7_ml8_gbt_train_valid", "ml6_ml11_forest_importances", "smp6_smote_rows",
        "smp6_smote_neighbours"}  # these run jobs while building (fits, loops)


def _find(pattern: str, text: str) -> str:
    m = re.search(pattern, text)
    return m.group(1) if m else ""


def summarize(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"\bExchange\b", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "nested_loop": len(re.findall(r"NestedLoopJoin|CartesianProduct", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "scans": sorted(set((_find(r"ReadSchema: (struct<[^>]*>?)", m), _find(r"PushedFilters: (\[[^\]]*\]?)", m))
                            for m in re.findall(r"FileScan parquet [^\n]*", plan))),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    sys.path.insert(0, ".")
    from riskframe.plans.catalog import REGISTRY
    from riskframe.session import ensure_checkpoint_dir, local_session
    spark = local_session(8)
    ensure_checkpoint_dir(spark)
    bad = 0
    for name in argv[2:] or sorted(REGISTRY):
        if name in SKIP and not argv[2:]:
            continue
        plan = REGISTRY[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        bad += s["nested_loop"]
        print(f"{name:36s} exch={s['exchanges']:3d} bcast={s['broadcasts']:2d} smj={s['smj']:2d} "
              f"nlj={s['nested_loop']} win={s['windows']:2d}")
        for schema, pushed in s["scans"]:
            print(f"    scan {schema[:110]} {pushed[:80]}")
    print("nested-loop/cartesian joins:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
