"""Ranges of an id column, for work in id order without one task that sees every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bounds(df: DataFrame, col: str, rows: int, most: int = 512) -> list[int]:
    """Lower bounds of id ranges with about `rows` rows each; at most `most` numbers come to the driver."""
    n = df.select(col).count()
    parts = min(most, max(1, -(-n // rows)))
    if parts == 1:
        return []
    at = F.percentile_approx(F.col(col), F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(20000))
    return sorted(set(df.agg(at.alias("b")).first().b or []))


def range_of(col: Column, bounds: list[int]) -> Column:
    """Number of the range an id lies in; null lies in the first."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    if len(bounds) <= 8:
        return reduce(lambda a, b: a + b, (F.when(col >= b, 1).otherwise(0) for b in bounds))
    return F.when(col >= bounds[mid], range_of(col, bounds[mid + 1 :]) + mid + 1).otherwise(range_of(col, bounds[:mid]))
