"""A plan in one line, inside out, and Catalyst's own account of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.sink import NULL
from .analyzer import Analyzed
from .estimate import TableSize, cost, join_order, steps


def outline(q: Analyzed, sizes: Mapping[str, TableSize] | None = None) -> str:
    """The query's operators as one expression, in the order in which they are declared:
    operator[what it goes by](inputs)."""
    edges = [frozenset((p.left.table, p.right.table)) for p in q.edges]
    listed = lambda x: ", ".join(map(str, x))
    over = lambda name, by, *inputs: f"{name}[{listed(by)}]({', '.join(inputs)})"
    out = ""
    for table, own in join_order(q, sizes):
        leaf = over("filter", q.filters[table], table) if q.filters[table] else table
        method = next((q.spec.methods[edges[i]] for i in own if edges[i] in q.spec.methods), None)
        name = (f"{method}_join" if method else "join") if own else "product"
        out = over(name, [q.edges[i] for i in own], out, leaf) if out else leaf
    if q.aggregates:
        out = over("aggregate", q.spec.group_by, out)
    elif q.spec.group_by:
        out = over("distinct", q.spec.group_by, out)
    if not q.spec.star:
        out = over("project", q.output, out)
    if q.spec.distinct:
        out = over("distinct", (), out)
    if q.spec.order_by:
        out = over("sort", [f"{c} desc" if q.spec.descending else c for c in q.spec.order_by], out)
    return out


def estimated(q: Analyzed, sizes: Mapping[str, TableSize] | None) -> str:
    """Rows expected of each table after its filters and of each join, and the cost: all of them."""
    if sizes is None:
        return "no estimate: a stream has no size"
    of = steps(q, join_order(q, sizes), sizes)
    parts = [f"{s.table} {s.own:.0f}" + (f", joined {s.rows:.0f}" if k else "") for k, s in enumerate(of)]
    return f"estimated rows: {'; '.join(parts)}; cost {cost(of):.0f}"


def pretty(x: object) -> str:
    """A schema, a row, several rows or a part of a query as text: a schema's columns with their types, a
    row's values parted by tabs, rows in lines."""
    if isinstance(x, T.StructType):
        of = lambda f: f"{f.metadata['table']}." if "table" in f.metadata else ""
        return "\n".join(f"{of(f)}{f.name} {f.dataType.simpleString()}" for f in x.fields)
    if isinstance(x, tuple):
        return "\t".join(NULL if v is None else str(v) for v in x)
    return "\n".join(map(pretty, x)) if isinstance(x, list) else str(x)


def account(df: DataFrame, mode: str = "formatted") -> str:
    """explain() as text: formatted, cost, simple, extended or codegen."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
