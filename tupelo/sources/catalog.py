"""Tables by name. A name is taken exactly as it is written."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import CatalogError
from ..operators.joins import known_size
from ..plans.estimate import TableSize
from .ddl import TableStats, parse_stats, read_det
from .text import load_text, read_text


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}
        self.stats: dict[str, TableStats] = {}
        self._sizes: dict[str, TableSize] = {}

    def register(self, name: str, df: DataFrame) -> Catalog:
        self._tables[name] = df
        self._forget(name)
        return self

    def parquet(self, name: str, path: str) -> Catalog:
        """A Parquet table; its footer is read when a query first names it."""
        self._paths[name] = path
        self._tables.pop(name, None)
        self._forget(name)
        return self

    def _forget(self, name: str) -> None:
        """What was known of another table of that name."""
        self.stats.pop(name, None)
        self._sizes.pop(name, None)

    def parquet_dir(self, folder: str, *names: str) -> Catalog:
        """Tables <folder>/<name>.parquet; without names, all that a local folder holds."""
        for name in names or sorted(p.stem for p in Path(folder).glob("*.parquet")):
            self.parquet(name, f"{folder}/{name}.parquet")
        return self

    def orc(self, name: str, path: str) -> Catalog:
        return self.register(name, self.spark.read.orc(path))

    def text(self, name: str, path: str, schema: T.StructType, delimiter: str | None = None, target: str | None = None) -> Catalog:
        """A text table, read in place or loaded into Parquet at target first."""
        df = load_text(self.spark, path, schema, target, delimiter) if target else read_text(self.spark, path, schema, delimiter)
        return self.register(name, df)

    def defined_dir(self, folder: str) -> Catalog:
        """Tables by their `.det` files: the Parquet folder beside one, or else its `.txt`; and their `.stat`."""
        for det in sorted(Path(folder).glob("*.det")):
            table, at = read_det(det), det.with_suffix("")
            if at.with_suffix(".parquet").exists():
                self.parquet(table.table, str(at.with_suffix(".parquet")))
            elif at.with_suffix(".txt").exists():
                self.text(table.table, str(at.with_suffix(".txt")), table.schema)
            else:
                continue
            if at.with_suffix(".stat").exists():
                self.stats[table.table] = parse_stats(table.table, at.with_suffix(".stat").read_text(), len(table.columns))
        return self

    def names(self) -> list[str]:
        return sorted({*self._tables, *self._paths})

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name not in self._paths:
                raise CatalogError(f"no table {name}; there are {', '.join(self.names()) or 'none'}")
            self._tables[name] = self.spark.read.parquet(self._paths[name])
        return self._tables[name]

    def size(self, name: str) -> TableSize:
        """By the table's statistics, or else by its bytes, as Catalyst bounds them, and the width of a row."""
        df = self.table(name)
        if name in self.stats:
            return TableSize(self.stats[name].rows, dict(zip(df.columns, self.stats[name].distinct, strict=True)))
        if name not in self._sizes:
            self._sizes[name] = TableSize(max(1.0, known_size(df) / df._jdf.schema().defaultSize()))
        return self._sizes[name]

    def analyze(self, name: str) -> TableStats:
        """Row count and distinct counts (approximate, in one pass) of a table; kept in stats."""
        from pyspark.sql import functions as F

        df = self.table(name)
        row = df.agg(F.count("*"), *[F.approx_count_distinct(f"`{c}`") for c in df.columns]).first()
        self.stats[name] = TableStats(row[0], tuple(row[1:]))
        return self.stats[name]
