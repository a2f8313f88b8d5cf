"""The command line: runs a script of the dialect over Parquet files or a catalog and prints the last result."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lakevec.errors import LakevecError
from lakevec.session import Engine
from lakevec.sources.io import FORMATS, render


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakevec", description=__doc__)
    p.add_argument("sql", help="a script, or - to read it from standard input")
    p.add_argument("--root", help="directory of the catalog")
    p.add_argument("--data", help="directory whose .parquet files are tables")
    p.add_argument("--output", choices=FORMATS, default="table")
    p.add_argument("--limit", type=int, help="most rows to print")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("lakevec").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, o.root)
    if o.data:
        engine.register_parquet(o.data, *(f.stem for f in Path(o.data).glob("*.parquet")))
    try:
        result = engine.execute(sys.stdin.read() if o.sql == "-" else o.sql)
    except LakevecError as e:
        print(e, file=sys.stderr)
        return 1
    if result.rows is not None:
        print(render(result.rows, o.output, o.limit), end="")
    elif result.affected is not None:
        print(f"{result.affected} rows affected")
    return 0


if __name__ == "__main__":
    sys.exit(main())
