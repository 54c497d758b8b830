"""Command line.

    python -m tupelo run <query file> <result file> [page size] [buffers] [-y] --data <folder>
    python -m tupelo gen <folder> <table> <rows> [--seed n]
    python -m tupelo load <folder> <table> [--delimiter d]

run plans the query, prints the plan, asks whether to go on unless -y (or any fifth argument) is
given, and writes the result. Page size and buffers are accepted and have no effect: Spark manages
memory. gen reads <table>.det and writes <table>.parquet, .txt and .stat; load makes the Parquet
table from <table>.txt.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import TupeloError
from .sources.catalog import Catalog
from .sources.datagen import generate, statistics
from .sources.ddl import read_det
from .sources.sink import write_lines
from .sources.text import load_text


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tupelo")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("result")
    run.add_argument("unused", nargs="*", help="page size, buffers, and anything to run without asking")
    run.add_argument("--data", default=".")
    run.add_argument("-y", "--yes", action="store_true")
    gen = sub.add_parser("gen")
    gen.add_argument("folder")
    gen.add_argument("table")
    gen.add_argument("rows", type=int)
    gen.add_argument("--seed", type=int, default=42)
    load = sub.add_parser("load")
    load.add_argument("folder")
    load.add_argument("table")
    load.add_argument("--delimiter")
    return top.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = _arguments(argv)
    spark = spark or SparkSession.builder.appName("tupelo").getOrCreate()
    try:
        if a.command == "run":
            catalog = Catalog(spark).parquet_dir(a.data).defined_dir(a.data)
            engine = Engine(spark, catalog)
            source = Path(a.query).read_text()
            print(engine.explain(source, "cost"))
            if not a.yes and len(a.unused) < 3 and input("run it? 1 yes, 0 no: ").strip() == "0":
                return 1
            print(f"{engine.write(source, a.result):.3f} seconds")
            return 0
        at = Path(a.folder) / a.table
        table = read_det(at.with_suffix(".det"))
        if a.command == "gen":
            generate(spark, table, a.rows, a.seed).write.mode("overwrite").parquet(str(at.with_suffix(".parquet")))
            made = spark.read.parquet(str(at.with_suffix(".parquet")))
            write_lines(made, str(at.with_suffix(".txt")))
            at.with_suffix(".stat").write_text(str(statistics(made, table)))
        else:
            load_text(spark, str(at.with_suffix(".txt")), table.schema, str(at.with_suffix(".parquet")), a.delimiter)
        return 0
    except (TupeloError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
