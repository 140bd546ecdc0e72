"""Reading audit rows whose optional columns may be absent."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Row:
    """Column access with a default for columns a caller did not supply."""

    def __init__(self, df: DataFrame):
        self._names = set(df.columns)

    def has(self, name: str) -> bool:
        return name in self._names

    def get(self, name: str, default: Any = None) -> Column:
        return F.col(name) if name in self._names else F.lit(default)

    def flag(self, name: str, default: bool = False) -> Column:
        if name not in self._names:
            return F.lit(default)
        return F.coalesce(F.col(name).cast("boolean"), F.lit(default))

    def text(self, name: str) -> Column:
        return F.coalesce(self.get(name).cast("string"), F.lit(""))

    def number(self, name: str) -> Column:
        return self.get(name).cast("double")

    def count(self, name: str) -> Column:
        return F.coalesce(self.get(name).cast("int"), F.lit(0))


def joined(*parts: Column, sep: str = "; ") -> Column:
    """Join the parts that are not null."""
    return F.concat_ws(sep, *parts)


def shown(number: Column) -> Column:
    """A whole-number rendering of a metric for messages."""
    return F.bround(number, 0).cast("long").cast("string")
