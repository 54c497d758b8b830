"""Queries as data: what the parser and the builder make and the analyzer reads."""

from __future__ import annotations

from dataclasses import dataclass, field

# The dialect's comparators and aggregates.
COMPARATORS = ("<", ">", "<=", ">=", "=", "!=")
AGGREGATES = ("MAX", "MIN", "SUM", "COUNT", "AVG")


@dataclass(frozen=True)
class ColRef:
    table: str
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}"


@dataclass(frozen=True)
class AggRef:
    """An aggregate of a column; of another aggregate only in queries that the analyzer rejects."""

    fn: str
    arg: ColRef | AggRef

    def __str__(self) -> str:
        return f"{self.fn}({self.arg})"


@dataclass(frozen=True)
class Literal:
    """The text between the quotes; its type is that of the column it is compared with."""

    text: str

    def __str__(self) -> str:
        return f'"{self.text}"'


@dataclass(frozen=True)
class Predicate:
    left: ColRef | AggRef
    op: str
    right: ColRef | AggRef | Literal

    def __str__(self) -> str:
        return f"{self.left}{self.op}{self.right}"


@dataclass(frozen=True)
class QuerySpec:
    """select is empty for SELECT *."""

    tables: tuple[str, ...]
    select: tuple[ColRef | AggRef, ...] = ()
    distinct: bool = False
    where: tuple[Predicate, ...] = ()
    group_by: tuple[ColRef | AggRef, ...] = ()
    order_by: tuple[ColRef | AggRef, ...] = ()
    descending: bool = False
    #: Join methods by unordered pair of tables, from the builder; the dialect has no syntax for them.
    methods: dict[frozenset[str], str] = field(default_factory=dict, compare=False)

    @property
    def star(self) -> bool:
        return not self.select

    def __str__(self) -> str:
        join = lambda x: ",".join(map(str, x))
        out = [f"SELECT {'DISTINCT ' if self.distinct else ''}{join(self.select) or '*'}", f"FROM {join(self.tables)}"]
        if self.where:
            out.append(f"WHERE {join(self.where)}")
        if self.group_by:
            out.append(f"GROUPBY {join(self.group_by)}")
        if self.order_by:
            out.append(f"ORDERBY {join(self.order_by)}{' DESC' if self.descending else ''}")
        return " ".join(out)
