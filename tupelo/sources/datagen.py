"""Seeded random tables from their definitions, made by the executors from row numbers alone."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError
from .ddl import ColumnDef, TableDef, TableStats


def _draw(k: int, seed: int, of: int, *more: Column) -> Column:
    """A uniform number below `of` for each row."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k), *more), F.lit(of))


def _unique(k: int, seed: int, of: int) -> Column:
    """Different numbers below `of` for different rows, as long as there are that many: a step through
    all residues, with no factor in common with their number."""
    step = of // 2 + (seed * 7919 + k * 104_729) % max(1, of)
    while gcd(step, of) != 1:
        step += 1
    return F.pmod(F.col("id") * F.lit(step % of) + F.lit((seed * 31 + k * 17) % of), F.lit(of))


def _column(k: int, c: ColumnDef, table: TableDef, n: int, seed: int) -> Column:
    if c.type == "STRING":
        letter = lambda i: F.char(F.lit(97) + _draw(k, seed, 26, i))
        value = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(c.range)), letter)) if c.range else F.lit("")
    elif c.range < 1:
        raise CatalogError(f"{table.table}.{c.name}: a number's range is at least 1")
    elif c.type == "REAL":
        value = _draw(k, seed, 1 << 24) * F.lit(c.range / (1 << 24))
    elif c.key == "PK":
        # Keys are drawn from the range of the first column, whichever column they are.
        if (of := table.columns[0].range) < n:
            raise CatalogError(f"{table.table}.{c.name}: {n} different keys don't fit below {of}")
        value = _unique(k, seed, of)
    else:
        value = _draw(k, seed, c.range)
    return value.cast(table.schema[c.name].dataType).alias(c.name)


def generate(spark: SparkSession, table: TableDef, n: int, seed: int = 42) -> DataFrame:
    """n rows: keys without repeats, other integers and reals uniform below the column's range, strings
    of its length from a to z. The same seed gives the same rows."""
    if n < 0:
        raise CatalogError("a table can't have fewer than no rows")
    return spark.range(n).select(*[_column(k, c, table, n, seed) for k, c in enumerate(table.columns)])


def statistics(df: DataFrame, table: TableDef) -> TableStats:
    """Row count, and per column the distinct values: exact for keys, bounded by range and rows for other
    integers, the rows for the rest. One pass, with the keys' distinct values counted in it."""
    keys = [c.name for c in table.columns if c.key in ("PK", "FK") and c.type == "INTEGER"]
    row = df.agg(F.count("*").alias("n"), *[F.countDistinct(f"`{k}`").alias(f"d{i}") for i, k in enumerate(keys)]).first()
    n = row["n"]
    exact = {k: row[f"d{i}"] for i, k in enumerate(keys)}
    return TableStats(n, tuple(exact[c.name] if c.name in exact else min(n, c.range) if c.type == "INTEGER" else n for c in table.columns))
