"""Conditions: leaves with & | ~, compiled to Catalyst expressions with typed literals."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = re.compile(r"[ \t\n\v\f\r]*([+-]?\d+)")
REAL = re.compile(r"[ \t\n\v\f\r]*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?|nan))", re.I)
OPERATORS = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


def coerce(value: Any, kind: T.DataType) -> Column | None:
    """A literal of the column's type: the leading number of a string, 0 if there is none; None if the type can't be compared."""
    text = ("true" if value else "false") if isinstance(value, bool) else str(value)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        m = WHOLE.match(text)
        number = max(-(2**63), min(2**63 - 1, int(m[1]) if m else 0))
        return F.lit(number) if isinstance(kind, T.LongType) or abs(number) >= 2**31 else F.lit(number).cast("int")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        m = REAL.match(text)
        return F.lit(float(m[1]) if m else 0.0)
    if isinstance(kind, T.StringType):
        return F.lit(text)
    if isinstance(kind, T.BooleanType):
        return F.lit(text in ("true", "1"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(text).cast(kind)
    return None


@dataclass(frozen=True)
class Cond:
    """A leaf (column, op, value) or and / or / not of others.  Logic has two values: what can't be told is false."""

    kind: str
    args: tuple

    def __and__(self, other: Cond) -> Cond:
        return Cond("and", (self, other))

    def __or__(self, other: Cond) -> Cond:
        return Cond("or", (self, other))

    def __invert__(self) -> Cond:
        return Cond("not", (self,))

    def to_column(self, schema: T.StructType) -> Column:
        if self.kind == "and":
            return self.args[0].to_column(schema) & self.args[1].to_column(schema)
        if self.kind == "or":
            return self.args[0].to_column(schema) | self.args[1].to_column(schema)
        if self.kind == "not":
            return ~F.coalesce(self.args[0].to_column(schema), F.lit(False))
        name, op, value = self.args
        if op not in OPERATORS or name not in schema.fieldNames():
            return F.lit(False)
        literal = coerce(value, schema[name].dataType)
        if literal is None:
            return F.lit(False)
        own = F.col(f"`{name}`")
        own = own.cast("double") if isinstance(schema[name].dataType, T.FloatType) else own
        return getattr(own, OPERATORS[op])(literal)


def cond(column: str, op: str, value: Any) -> Cond:
    return Cond("leaf", (column, op, value))
