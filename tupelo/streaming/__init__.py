"""Queries over unbounded tables.

A catalog takes streaming DataFrames like others: filters, projections and joins with bounded tables
run on them as they are, and aggregates in complete or update mode. What can't run without an end
is refused here, before a stream starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..errors import AnalysisError
from ..plans.spec import QuerySpec


def stream(engine: Engine, query: str | QuerySpec, names: list[str] | None = None) -> DataFrame:
    """The result of a query that names at least one streaming table, to be written with writeStream."""
    q = engine.analyze(query)
    unbounded = [t for t in q.spec.tables if engine.catalog.table(t).isStreaming]
    if not unbounded:
        raise AnalysisError("no table in FROM is a stream")
    if q.spec.order_by and not q.aggregates:
        raise AnalysisError("ORDERBY has no end to wait for on a stream without aggregates")
    return engine.query(query, names=names)
