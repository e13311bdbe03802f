"""Command line: list and run the registered queries.

    python -m churnlab list
    python -m churnlab run jn4_user_matrix --data /root/testdata/sf0.01 --show 20
    python -m churnlab run agg2_listens_by_state --data DIR --out /shared/out --format parquet
    python -m churnlab sql jn4_user_matrix          # print the DuckDB oracle SQL
"""

from __future__ import annotations

import argparse
import sys

from churnlab.plans.catalog import NO_ORACLE, QUERIES
from churnlab.plans.oracle import SQL


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="churnlab")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--data", required=True, help="folder with the parquet tables")
    run.add_argument("--show", type=int, default=20, help="rows to print (0: none)")
    run.add_argument("--out", help="write the full result here instead of printing")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    run.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    sql = sub.add_parser("sql", help="print the DuckDB oracle SQL of a query")
    sql.add_argument("query", choices=sorted(SQL))
    args = p.parse_args(argv)

    if args.cmd == "list":
        for name in QUERIES:
            print(name + ("" if name not in NO_ORACLE else "   (model training, no SQL oracle)"))
        return 0
    if args.cmd == "sql":
        print(SQL[args.query])
        return 0

    from churnlab.session import local_session
    from churnlab.sources.sinks import write_table

    spark = local_session()
    try:
        df = QUERIES[args.query](spark, args.data)
        if args.explain:
            df.explain("formatted")
        if args.out:
            write_table(df, args.out, fmt=args.format)
        elif args.show:
            df.show(args.show, truncate=False)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
