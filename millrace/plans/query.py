"""The fluent query: scan, filter, sort, limit, then one left outer lookup; each step gives a new builder."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import INVAL, NOTFOUND, EngineError
from millrace.plans.predicate import Cond, cond


@dataclass(frozen=True)
class Query:
    engine: Any
    table: str
    condition: Cond | None = None
    order: tuple[str, bool] | None = None
    most: int | None = None
    lookup: tuple[str, str, str] | None = None

    def from_(self, table: str) -> Query:
        return replace(self, table=table)

    def filter(self, column: str, op: str, value: Any) -> Query:
        leaf = cond(column, op, value)
        return replace(self, condition=leaf if self.condition is None else self.condition & leaf)

    def where(self, condition: Cond) -> Query:
        """Replaces every earlier condition; later filters are added to it."""
        return replace(self, condition=condition)

    def sort(self, column: str, ascending: bool | int = True) -> Query:
        return replace(self, order=(column, bool(ascending)))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise EngineError(INVAL, f"limit {n}")
        return replace(self, most=n)

    def join(self, table: str, on_local: str, on_foreign: str) -> Query:
        return replace(self, lookup=(table, on_local, on_foreign))

    def to_df(self) -> DataFrame:
        """Lazy.  The limit bounds the left side; rows without a match stay; the foreign key column goes."""
        df, key = self.engine.scan(self.table), self.engine.key(self.table)
        if self.condition is not None:
            df = df.where(self.condition.to_column(df.schema))
        by = []
        if self.order and self.order[0] in df.columns:
            name, up = self.order
            by = [F.col(f"`{name}`").asc() if up else F.col(f"`{name}`").desc()]
            by += [F.col(f"`{key}`").asc()] if key in df.columns and key != name else []
            df = df.orderBy(*by)
        if self.most is not None:
            df = df.limit(self.most)
        if self.lookup:
            table, local, foreign = self.lookup
            right = self.engine.scan(table)
            if local not in df.columns or foreign not in right.columns:
                raise EngineError(NOTFOUND, f"{local} = {table}.{foreign}")
            if foreign != self.engine.key(table):
                raise EngineError(INVAL, f"{foreign} isn't the key of {table}")
            clash = {c: f"{table}_{c}" for c in right.columns if c in df.columns and c != foreign}
            right = right.withColumnsRenamed(clash).withColumnRenamed(foreign, "__foreign")
            df = df.join(right, df[local] == right["__foreign"], "left").drop("__foreign")
            df = df.orderBy(*by) if by else df
        return df

    def rows(self):
        """A forward cursor."""
        return self.to_df().toLocalIterator()
