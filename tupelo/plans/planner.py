"""An analyzed query as a DataFrame. Everything is declared; Catalyst prunes, pushes down and orders.

Inside the plan a column is called table.column, so equal names of two tables never meet.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.literals import literal
from ..operators.joins import join
from .analyzer import Analyzed
from .estimate import TableSize, join_order
from .spec import AggRef, ColRef, Literal, Predicate

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}


def column(c: ColRef | AggRef) -> Column:
    return F.col(f"`{c}`")


def _predicate(p: Predicate, q: Analyzed) -> Column:
    right = literal(p.right.text, q.types[p.left], str(p.left)) if isinstance(p.right, Literal) else column(p.right)
    return _COMPARE[p.op](column(p.left), right)


def scan(table: str, df: DataFrame, q: Analyzed) -> DataFrame:
    """A table's columns under their inside names, and its own predicates, next to the source."""
    out = df.select(*[F.col(f"`{f.name}`").alias(f"{table}.{f.name}") for f in df.schema.fields])
    for p in q.filters[table]:
        out = out.where(_predicate(p, q))
    return out


def source(q: Analyzed, tables: Mapping[str, DataFrame], sizes: Mapping[str, TableSize] | None = None) -> DataFrame:
    """The joined rows that the query's select list reads, joined in the order that sizes suggest."""
    edges = [frozenset((p.left.table, p.right.table)) for p in q.edges]
    out = None
    for table, own in join_order(q, sizes):
        right = scan(table, tables[table], q)
        if out is None:
            out = right
            continue
        used = [q.edges[i] for i in own]
        method = next((q.spec.methods[edges[i]] for i in own if edges[i] in q.spec.methods), None)
        out = join(out, right, [_predicate(p, q) for p in used], any(p.op == "=" for p in used), method)
    return out


def plan(q: Analyzed, tables: Mapping[str, DataFrame], sizes: Mapping[str, TableSize] | None = None) -> DataFrame:
    """The result, its columns under their inside names: table.column or FN(table.column)."""
    spec, out = q.spec, source(q, tables, sizes)
    order = [column(c).desc() if spec.descending else column(c).asc() for c in spec.order_by]
    hidden = any(c not in q.output for c in spec.order_by)
    if q.aggregates:
        calls = dict.fromkeys(c for c in q.output if isinstance(c, AggRef))
        out = out.groupBy(*map(column, dict.fromkeys(spec.group_by))).agg(*[aggregate(c.fn, column(c.arg), q.types[c.arg], str(c.arg)).alias(str(c)) for c in calls])
    elif spec.group_by:
        out = out.select(*map(column, dict.fromkeys(spec.group_by))).distinct()
    if order and hidden:
        out = out.orderBy(*order)
    out = out.select(*map(column, dict.fromkeys(q.output)))
    if spec.distinct:
        out = out.distinct()
    if order and not hidden:
        out = out.orderBy(*order)
    return out


def output_names(q: Analyzed) -> list[str]:
    """A bare column name where it is the only one, else table.column; aggregates as fn_table_column."""
    bare = Counter(c.name for c in q.output if isinstance(c, ColRef))
    return [str(c) if isinstance(c, ColRef) and bare[c.name] > 1 else c.name if isinstance(c, ColRef) else f"{c.fn.lower()}_{c.arg.table}_{c.arg.name}" for c in q.output]


def named(df: DataFrame, q: Analyzed, names: list[str]) -> DataFrame:
    return df.select(*[column(c).alias(n) for c, n in zip(q.output, names, strict=True)])
