"""Text tables: one row a line, values separated by white space or a delimiter, no header."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError


def read_text(spark: SparkSession, path: str, schema: T.StructType, delimiter: str | None = None) -> DataFrame:
    """Rows of a text table, cast to the schema while they are read.

    By default values are what stands between runs of white space, so a string can't hold any; a
    delimiter is taken literally. Blank lines are left out. A line with too few values, or one that
    doesn't cast, raises when it is read; values beyond the schema's are ignored.
    """
    lines = spark.read.text(path)
    if delimiter is None:
        parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    else:
        parts = F.split("value", re.escape(delimiter))
    rows = lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(parts.alias("parts"), "value")
    enough = F.when(F.size("parts") < len(schema), F.raise_error(F.concat(F.lit(f"{len(schema)} values wanted: "), F.col("value")))).otherwise(F.col("parts"))
    rows = rows.select(enough.alias("parts"))
    return rows.select(*[F.col("parts")[i].cast(f.dataType).alias(f.name, metadata=f.metadata) for i, f in enumerate(schema.fields)])


def load_text(spark: SparkSession, path: str, schema: T.StructType, target: str, delimiter: str | None = None) -> DataFrame:
    """A text table written as Parquet, and that read."""
    if not len(schema):
        raise CatalogError("a table needs a column")
    read_text(spark, path, schema, delimiter).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
