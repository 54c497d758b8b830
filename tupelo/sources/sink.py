"""Results as text: a header of columns, then a row a line, each value followed by a tab."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of a result file.
NULL, AFTER_NAME, AFTER_VALUE = "-NULL-", "  ", "\t"


def header(names: Sequence[str]) -> str:
    return "".join(n + AFTER_NAME for n in names)


def line(df: DataFrame) -> Column:
    """A row as its line, made by the executors."""
    values = [F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)), F.lit(AFTER_VALUE)) for c in df.columns]
    return F.concat(*values) if values else F.lit("")


def write_result(df: DataFrame, path: str, names: Sequence[str] | None = None) -> float:
    """Writes one local file, a partition at a time, in the result's order; returns the seconds it took."""
    began = time.perf_counter()
    with open(path, "w", encoding="utf-8") as out:
        out.write(header(names or df.columns) + "\n")
        for row in df.select(line(df).alias("line")).toLocalIterator(prefetchPartitions=True):
            out.write(row["line"] + "\n")
    return time.perf_counter() - began


def write_lines(df: DataFrame, folder: str) -> None:
    """The same lines, without a header, as a folder of files written in parallel."""
    df.select(line(df).alias("value")).write.mode("overwrite").text(folder)
