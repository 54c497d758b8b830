"""Literals take the type of the column that they are compared with, once, before the query runs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError

#: Families of types that can be compared with each other.
FAMILIES = {"INT": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "REAL": (T.FloatType, T.DoubleType, T.DecimalType), "STRING": (T.StringType, T.CharType, T.VarcharType)}
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_INT = re.compile(r"[+-]?[0-9]+")
_REAL = re.compile(r"\s*[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?\s*")


def family(kind: T.DataType) -> str | None:
    return next((name for name, kinds in FAMILIES.items() if isinstance(kind, kinds)), None)


def literal(text: str, kind: T.DataType, what: str) -> Column:
    """text as a value of a column type: a decimal integer that fits, a number in the column's own
    precision, or the text itself."""
    group = family(kind)
    if group == "INT":
        bits = _BITS[type(kind)]
        if not _INT.fullmatch(text) or not -(1 << bits - 1) <= int(text) < 1 << bits - 1:
            raise AnalysisError(f'"{text}" is no integer of {bits} bits, as {what} is')
        return F.lit(int(text)).cast(kind)
    if group == "REAL":
        if not _REAL.fullmatch(text):
            raise AnalysisError(f'"{text}" is no number, as {what} is')
        # By the text, not by way of a double: a float column's "0.1" is the float nearest to 0.1.
        return F.lit(text.strip().rstrip("fFdD") if not text.strip().endswith(("NaN", "Infinity")) else text.strip()).cast(kind)
    if group == "STRING":
        return F.lit(text)
    raise AnalysisError(f"{what} of type {kind.simpleString()} can't be compared with a literal")
