"""A select-project-join query engine and training-data toolkit on PySpark."""

from .builder import table
from .engine import Engine
from .errors import AnalysisError, CatalogError, ParseError, TupeloError
from .plans.parser import parse
from .sources.catalog import Catalog

__all__ = ["AnalysisError", "Catalog", "CatalogError", "Engine", "ParseError", "TupeloError", "parse", "table"]
