"""Command line: list the registered queries, or run one over a folder of tables.

    python -m runlens list
    python -m runlens run <key> <tables_dir> [--out <path>] [--format parquet|json|csv] [--show N]
    python -m runlens sql <key>            # the DuckDB oracle SQL of a key, when there is one

Runs against the Spark session of the environment (``spark-submit -m`` style) or a local one.
Results are written by Spark (``--out``) or a few rows are shown; nothing is collected whole.
"""

from __future__ import annotations

import argparse
import sys

from .plans import registry


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="runlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("key")
    r.add_argument("tables_dir")
    r.add_argument("--out")
    r.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    r.add_argument("--show", type=int, default=20)
    q = sub.add_parser("sql")
    q.add_argument("key")
    a = p.parse_args(argv)
    registry.load_all()
    if a.cmd == "list":
        for k in sorted(registry.QUERIES):
            print(f"{k}\t{'sql' if k in registry.ORACLES else 'rows'}")
        return 0
    if a.cmd == "sql":
        print(registry.ORACLES.get(a.key, f"-- no SQL oracle for {a.key}"))
        return 0
    from pyspark.sql import SparkSession

    from .plans.session import cluster_session
    spark = SparkSession.getActiveSession() or cluster_session()
    df = registry.QUERIES[a.key](spark, a.tables_dir.rstrip("/"))
    if a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
        print(f"wrote {a.key} to {a.out}")
    else:
        df.show(a.show, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
