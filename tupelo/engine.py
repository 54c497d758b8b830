"""Parse, analyze and plan in one place."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisError, CatalogError
from .plans.analyzer import Analyzed, analyze
from .plans.estimate import TableSize
from .plans.explain import account, estimated, outline, pretty
from .plans.parser import parse
from .plans.planner import named, output_names, plan
from .plans.spec import QuerySpec
from .sources.catalog import Catalog
from .sources.sink import write_result


class Engine:
    """Runs queries in the dialect, or built ones, over a catalog of tables."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)

    def analyze(self, query: str | QuerySpec, methods: Mapping[tuple[str, str], str] | None = None) -> Analyzed:
        spec = parse(query) if isinstance(query, str) else query
        if methods:
            spec = QuerySpec(spec.tables, spec.select, spec.distinct, spec.where, spec.group_by, spec.order_by, spec.descending, {**spec.methods, **{frozenset(k): v for k, v in methods.items()}})
        try:
            schemas = {t: self.catalog.table(t).schema for t in spec.tables}
        except CatalogError as e:
            raise AnalysisError(str(e)) from e
        return analyze(spec, schemas)

    def query(self, query: str | QuerySpec, methods: Mapping[tuple[str, str], str] | None = None, names: list[str] | None = None) -> DataFrame:
        """The result as a lazy DataFrame. methods: join methods by pair of tables; names: of the output
        columns, by default bare column names where they are unique."""
        q = self.analyze(query, methods)
        return named(self._plan(q), q, names or output_names(q))

    def _sizes(self, q: Analyzed) -> dict[str, TableSize] | None:
        """Sizes of the query's tables; none for streams, which have no size."""
        if any(self.catalog.table(t).isStreaming for t in q.spec.tables):
            return None
        return {t: self.catalog.size(t) for t in q.spec.tables}

    def _plan(self, q: Analyzed) -> DataFrame:
        # Two tables join in either order; Catalyst picks the sides.
        return plan(q, {t: self.catalog.table(t) for t in q.spec.tables}, self._sizes(q) if len(q.spec.tables) > 2 else None)

    def write(self, query: str | QuerySpec, path: str) -> float:
        """Runs a query into a result file whose header has full column names; returns the seconds."""
        q = self.analyze(query)
        df = self._plan(q)
        order = [f"c{i}" for i in range(len(q.output))]
        return write_result(named(df, q, order), path, list(map(str, q.output)))

    def explain(self, query: str | QuerySpec, mode: str = "formatted") -> str:
        """The plan in one line, its estimated rows and cost, then Catalyst's account of it."""
        q = self.analyze(query)
        sizes = self._sizes(q)
        return f"{outline(q, sizes)}\n{estimated(q, sizes)}\n\n{account(self._plan(q), mode)}"

    def show(self, query: str | QuerySpec, rows: int = 20) -> str:
        """The result's columns and its first rows, as pretty() prints them."""
        q = self.analyze(query)
        return pretty([", ".join(map(str, q.output)), *self._plan(q).limit(rows).collect()])

    def run_file(self, query_path: str, result_path: str) -> float:
        return self.write(Path(query_path).read_text(), result_path)
