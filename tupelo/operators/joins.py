"""Inner joins over a graph of tables: order, conditions and methods.

Without a method Catalyst and adaptive execution choose by size. A method asks for one:

    nested        pairs of partitions, compared row by row, if both sides are known to be small; else
                  as without a method
    block_nested  the right side on every executor, or else the left one, if its rows, counted when the
                  query is planned, are small in memory; else as sort_merge
    sort_merge    both sides shuffled and sorted on the keys
    hash          both sides shuffled on the keys, a hash table per partition
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("nested", "block_nested", "sort_merge", "hash")
#: A side is broadcast by request only up to this size of its rows in memory; the driver holds several times that while it builds the table.
BROADCAST_BYTES = 64 << 20
#: What a row takes besides its values: null bits, its place in the table, and slots of the table's that stay empty.
ROW_BYTES = 64
#: Pairs of partitions are compared by request only up to this product of the sides' sizes: some 10 million pairs of rows.
PRODUCT_BYTES = 1 << 36


def known_size(df: DataFrame) -> int:
    """Bytes as Catalyst bounds them: of files times the growth of joins, never a count of rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_size(df: DataFrame) -> int:
    """Bytes of df's rows in a hash table in memory, counted in one pass over them: 8 for each value and its bytes where it
    isn't a plain number. Bytes of files don't tell, as repeated values take next to none there."""
    plain = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.DatetimeType)
    sized = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)).cast("long") for f in df.schema.fields if not isinstance(f.dataType, plain)]
    rows, more = df.agg(F.count("*"), F.sum(sum(sized, F.lit(0).cast("long")))).first()
    return rows * (ROW_BYTES + 8 * len(df.columns)) + (more or 0)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows take at most that many bytes in memory; only what Catalyst's bound allows is counted, so no stream."""
    return known_size(df) <= most and held_size(df) <= most


def hinted(left: DataFrame, right: DataFrame, method: str | None, equi: bool, product: int = PRODUCT_BYTES) -> DataFrame:
    if method is None:
        return right
    if method == "nested":
        return right.hint("shuffle_replicate_nl") if known_size(left) * known_size(right) <= product else right
    if not equi:
        return right
    return right.hint("shuffle_hash" if method == "hash" else "merge")


def join(left: DataFrame, right: DataFrame, conditions: Sequence[Column], equi: bool, method: str | None = None) -> DataFrame:
    """Inner join on all conditions at once; a product where there are none."""
    if not conditions:
        return left.crossJoin(right)
    on = conditions[0]
    for c in conditions[1:]:
        on = on & c
    if method == "block_nested":
        if small(right):
            right, method = F.broadcast(right), None
        elif small(left):
            left, method = F.broadcast(left), None
    return left.join(hinted(left, right, method, equi), on, "inner")


def walk(tables: Sequence[str], edges: Sequence[frozenset[str]]) -> list[tuple[str, list[int]]]:
    """The order in which tables join: from the first one on, always the first table of `tables` that
    an edge ties to those joined already, or the first left over if none is. With each go the
    numbers of the edges that then have all their tables."""
    joined, left, used, out = {tables[0]}, list(tables[1:]), set(), [(tables[0], [])]
    while left:
        tied = [t for t in left if any(t in e and e - {t} <= joined for e in edges)]
        table = (tied or left)[0]
        left.remove(table)
        joined.add(table)
        own = [i for i, e in enumerate(edges) if i not in used and e <= joined]
        used.update(own)
        out.append((table, own))
    return out
