"""Run registered queries: python -m spanscope --list | NAME... [--tables DIR] [--out DIR] [--format csv|latex|parquet]."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .queries import QUERIES
from .sources.sinks import latex, write_csv


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanscope")
    p.add_argument("names", nargs="*", help="queries, or prefixes of their names such as c4 or h")
    p.add_argument("--list", action="store_true")
    p.add_argument("--tables", default="/root/testdata/sf0.01")
    p.add_argument("--out")
    p.add_argument("--format", choices=["csv", "latex", "parquet"], default="csv")
    o = p.parse_args(args)
    if o.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    chosen = [n for n in QUERIES if any(n == x or n.startswith(x) for x in o.names)]
    if not chosen:
        p.error("no such query; --list names them")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    failed = 0
    for name in chosen:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, o.tables)
            if o.out is None:
                df.show(truncate=False)
            elif o.format == "csv":
                write_csv(df, f"{o.out}/{name}", single=True)
            elif o.format == "parquet":
                df.write.mode("overwrite").parquet(f"{o.out}/{name}")
            else:
                spark.createDataFrame([(latex(df, name),)], "tex string").coalesce(1).write.mode("overwrite").text(f"{o.out}/{name}")
            print(f"{name}: {time.perf_counter() - start:.1f} s")
        except Exception as e:
            failed += 1
            print(f"{name}: {e}", file=sys.stderr)
    print(f"{len(chosen) - failed} of {len(chosen)} done")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
