"""The five aggregates of the dialect. Partial aggregation before the shuffle comes with each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from .literals import family

_FUNCTIONS = {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "COUNT": F.count, "AVG": F.avg}


def aggregate(fn: str, column: Column, kind: T.DataType, what: str) -> Column:
    """MAX and MIN keep the type, SUM widens it, COUNT is a long of values that aren't null, AVG a double."""
    if fn in ("SUM", "AVG") and family(kind) not in ("INT", "REAL"):
        raise AnalysisError(f"{fn} of {what}, which isn't a number")
    return _FUNCTIONS[fn](column)
