"""Table definitions: `.det` files, and the statistics files beside them.

A definition is white-space separated: the number of columns; the bytes of a row; then for each
column its name, type (INTEGER, STRING or REAL), range, key (PK, FK or anything else) and bytes. The
range is the exclusive greatest value of a number, or the length of a string.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import types as T

from ..errors import CatalogError

# The type names of the format.
TYPES = {"INTEGER": T.IntegerType(), "STRING": T.StringType(), "REAL": T.FloatType()}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    range: int
    key: str
    size: int


@dataclass(frozen=True)
class TableDef:
    table: str
    row_bytes: int
    columns: tuple[ColumnDef, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], True, {"table": self.table, "key": c.key, "size": c.size}) for c in self.columns])


def parse_det(table: str, source: str) -> TableDef:
    lines = [x.split() for x in source.splitlines() if x.strip()]

    def number(x: str, what: str) -> int:
        if not x.isdigit():
            raise CatalogError(f"{table}: {what} is {x!r}, not a number")
        return int(x)

    if len(lines) < 2 or len(lines[0]) != 1 or len(lines[1]) != 1:
        raise CatalogError(f"{table}: a definition begins with the number of columns and the bytes of a row, a line each")
    count, row_bytes = number(lines[0][0], "the number of columns"), number(lines[1][0], "the row size")
    if len(lines) != count + 2:
        raise CatalogError(f"{table}: {count} columns announced, {len(lines) - 2} defined")
    columns = []
    for k, x in enumerate(lines[2:]):
        if len(x) != 5:
            raise CatalogError(f"{table}: column {k + 1} has {len(x)} fields, not name, type, range, key and bytes")
        if x[1] not in TYPES:
            raise CatalogError(f"{table}.{x[0]}: no type {x[1]}; there are {', '.join(TYPES)}")
        columns.append(ColumnDef(x[0], x[1], number(x[2], f"the range of {x[0]}"), x[3], number(x[4], f"the size of {x[0]}")))
    if len({c.name for c in columns}) < len(columns):
        raise CatalogError(f"{table}: a column name stands twice")
    return TableDef(table, row_bytes, tuple(columns))


def read_det(path: str | Path) -> TableDef:
    path = Path(path)
    if not path.is_file():
        raise CatalogError(f"no definition {path}")
    return parse_det(path.stem, path.read_text())


@dataclass(frozen=True)
class TableStats:
    """The number of rows, and of distinct values of each column."""

    rows: int
    distinct: tuple[int, ...]

    def __str__(self) -> str:
        return f"{self.rows}\n{'\t'.join(map(str, self.distinct))}\n"


def parse_stats(table: str, source: str, columns: int) -> TableStats:
    """The first line has one number and the second one per column; CatalogError otherwise."""
    lines = [x.split() for x in source.splitlines() if x.strip()]
    if len(lines) != 2 or len(lines[0]) != 1 or len(lines[1]) != columns or not all(x.isdigit() for line in lines for x in line):
        raise CatalogError(f"{table}: statistics are a line with the number of rows and one with {columns} numbers of distinct values")
    return TableStats(int(lines[0][0]), tuple(map(int, lines[1])))
