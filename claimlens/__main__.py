"""Command line: run reports, load or generate a claims model.

  python -m claimlens list
  python -m claimlens run q01_claims_per_month v1_monthly_kpi --tpch /root/testdata/sf0.01 --show 20
  python -m claimlens run 'c_*' --model /shared/claims --out /shared/reports
  python -m claimlens load --tpch /root/testdata/sf0.1 --out /shared/claims
  python -m claimlens generate --claims 1000000 --out /shared/synthetic
  python -m claimlens check --model /shared/claims        # exit 1 if any data-quality rule is broken

``run`` takes key names or shell-style patterns; the model comes from the
driver tables (``--tpch``), a written model (``--model``) or the generator
(``--generate N``). ``--out`` writes each result as Parquet under
``<out>/<key>``; otherwise results are printed.
"""

from __future__ import annotations

import argparse
import fnmatch
import os
import sys

from claimlens.plans.registry import REPORTS
from claimlens.session import build_session
from claimlens.sources import ClaimsModel, derive_model
from claimlens.sources.synth import generate_claims_model


def _model(spark, args) -> ClaimsModel:
    if args.tpch:
        return derive_model(spark, args.tpch)
    if args.model:
        return ClaimsModel.read(spark, args.model)
    if args.enforced_model:
        return ClaimsModel.read_enforced(spark, args.enforced_model)
    if args.generate:
        return generate_claims_model(spark, n=args.generate)
    raise SystemExit("give --tpch DIR, --model DIR, --enforced-model DIR or --generate N")


def _keys(patterns: list[str]) -> list[str]:
    keys = [k for k in REPORTS if any(fnmatch.fnmatch(k, p) for p in patterns)]
    if not keys:
        raise SystemExit(f"no report matches {patterns}; see 'python -m claimlens list'")
    return keys


DQ_KEYS = ["c_not_null", "c_whitelist", "c_range", "c_claim_rules", "c_primary_key", "c_unique", "c_foreign_key"]
ZERO_ROW_KEYS = ["i09_dq_summary", "s3_open_with_decision"]


def _check(model: ClaimsModel) -> int:
    """Print every broken rule; 0 when all rules hold, 1 otherwise."""
    broken = []
    for key in DQ_KEYS:
        for r in REPORTS[key](model).filter("violations > 0").collect():
            broken.append(f"{key}: {r.table_name}.{r.rule} = {r.violations}")
    for key in ZERO_ROW_KEYS:
        row = REPORTS[key](model).collect()[0].asDict()
        broken += [f"{key}: {name} = {value}" for name, value in row.items() if value]
    totals = REPORTS["c_month_spine_reconcile"](model).collect()[0].asDict()
    if len(set(totals.values())) > 1:
        broken.append(f"c_month_spine_reconcile: views disagree {totals}")
    print("\n".join(broken) if broken else "all data-quality rules hold")
    return 1 if broken else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimlens")
    parser.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    sub = parser.add_subparsers(dest="cmd", required=True)

    sub.add_parser("list", help="list report keys")

    run = sub.add_parser("run", help="run reports")
    run.add_argument("keys", nargs="+")
    src = run.add_mutually_exclusive_group()
    src.add_argument("--tpch", help="folder of driver tables to derive the model from")
    src.add_argument("--model", help="folder of a model written by 'load' or 'generate'")
    src.add_argument("--enforced-model", help="folder of a model written by 'load --enforce' (passing rows only)")
    src.add_argument("--generate", type=int, help="generate a synthetic model with N claims")
    run.add_argument("--show", type=int, default=None, help="rows to print per report (default: all)")
    run.add_argument("--out", help="write each result as Parquet under OUT/<key>")

    check = sub.add_parser("check", help="run every data-quality report; exit 1 if any rule is broken")
    src2 = check.add_mutually_exclusive_group(required=True)
    src2.add_argument("--tpch")
    src2.add_argument("--model")
    src2.add_argument("--enforced-model")
    src2.add_argument("--generate", type=int)

    load = sub.add_parser("load", help="derive the model from driver tables and write it")
    load.add_argument("--tpch", required=True)
    load.add_argument("--out", required=True)
    load.add_argument("--enforce", action="store_true",
                      help="split rows breaking a row rule into quarantine partitions")

    gen = sub.add_parser("generate", help="write a synthetic model")
    gen.add_argument("--claims", type=int, default=1200)
    gen.add_argument("--seed", type=int, default=4242)
    gen.add_argument("--draws", choices=["chained", "cumulative"], default="chained")
    gen.add_argument("--out", required=True)

    args = parser.parse_args(argv)
    if args.cmd == "list":
        print("\n".join(REPORTS))
        return 0

    spark = build_session(args.master)
    if args.cmd == "load":
        model = derive_model(spark, args.tpch)
        if args.enforce:
            model.write_enforced(args.out)
        else:
            model.write(args.out)
    elif args.cmd == "generate":
        generate_claims_model(spark, n=args.claims, seed=args.seed, draws=args.draws).write(args.out)
    elif args.cmd == "check":
        return _check(_model(spark, args))
    else:
        model = _model(spark, args)
        for key in _keys(args.keys):
            df = REPORTS[key](model)
            if args.out:
                df.write.mode("overwrite").parquet(os.path.join(args.out, key))
            else:
                print(f"--- {key}")
                rows = df.count()
                df.show(rows if args.show is None else args.show, truncate=False)
                if args.show is not None and args.show < rows:
                    print(f"{args.show} of {rows} rows; --out writes them all")
    return 0


if __name__ == "__main__":
    sys.exit(main())
