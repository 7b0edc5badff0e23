"""How values leave a query: exact numbers and instants as text.

Text keeps decimals exact and instants in UTC whatever client reads them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import instants as ts


def exact(column: str | Column, scale: int, name: str | None = None) -> Column:
    named = F.col(column) if isinstance(column, str) else column
    text = named.cast(f"decimal(34,{scale})").cast("string")
    return text.alias(name or column)


def stamp(column: str | Column, name: str | None = None) -> Column:
    named = F.col(column) if isinstance(column, str) else column
    return ts.iso(named).alias(name or column)


def month(column: str = "as_of", name: str = "month") -> Column:
    return ts.month_label(F.col(column)).alias(name)
