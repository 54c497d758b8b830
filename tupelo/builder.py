"""Queries built in Python, which become the same QuerySpec as the dialect's."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import AnalysisError
from .plans.spec import COMPARATORS, AggRef, ColRef, Literal, Predicate, QuerySpec


def col(name: str) -> ColRef:
    table, dot, column = name.partition(".")
    if not (table and dot and column):
        raise AnalysisError(f"{name!r}: columns are written table.column")
    return ColRef(table, column)


def max_(name: str) -> AggRef:
    return AggRef("MAX", col(name))


def min_(name: str) -> AggRef:
    return AggRef("MIN", col(name))


def sum_(name: str) -> AggRef:
    return AggRef("SUM", col(name))


def count(name: str) -> AggRef:
    return AggRef("COUNT", col(name))


def avg(name: str) -> AggRef:
    return AggRef("AVG", col(name))


def _ref(c: str | ColRef | AggRef) -> ColRef | AggRef:
    return col(c) if isinstance(c, str) else c


def _op(op: str) -> str:
    if op not in COMPARATORS:
        raise AnalysisError(f"no comparison {op!r}; there are {' '.join(COMPARATORS)}")
    return op


@dataclass(frozen=True)
class Query:
    """table("A").where("A.x", "<", 5).join("B", "A.id", "=", "B.id").select("A.x", max_("B.y"))..."""

    spec: QuerySpec

    def where(self, left: str, op: str, value: object) -> Query:
        """A comparison with a literal, or with a column given as col("T.c")."""
        right = value if isinstance(value, ColRef) else Literal(str(value))
        return Query(replace(self.spec, where=(*self.spec.where, Predicate(col(left), _op(op), right))))

    def join(self, table: str, left: str | None = None, op: str = "=", right: str | None = None, method: str | None = None) -> Query:
        """Adds a table; with columns, joined on them, and by the method if one is named."""
        spec = replace(self.spec, tables=(*self.spec.tables, table) if table not in self.spec.tables else self.spec.tables)
        if left is None or right is None:
            if method:
                raise AnalysisError("a join method needs a join condition")
            return Query(spec)
        p = Predicate(col(left), _op(op), col(right))
        methods = {**spec.methods, frozenset((p.left.table, p.right.table)): method} if method else spec.methods
        return Query(replace(spec, where=(*spec.where, p), methods=methods))

    def select(self, *columns: str | ColRef | AggRef) -> Query:
        return Query(replace(self.spec, select=tuple(map(_ref, columns))))

    def distinct(self) -> Query:
        return Query(replace(self.spec, distinct=True))

    def group_by(self, *columns: str | ColRef) -> Query:
        return Query(replace(self.spec, group_by=tuple(map(_ref, columns))))

    def order_by(self, *columns: str | ColRef | AggRef, descending: bool = False) -> Query:
        return Query(replace(self.spec, order_by=tuple(map(_ref, columns)), descending=descending))


def table(name: str) -> Query:
    return Query(QuerySpec((name,)))
