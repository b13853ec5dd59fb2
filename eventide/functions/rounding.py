"""Rounding that never yields a negative zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: Column | str, places: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), places) + F.lit(0.0)


def rnd_wide(col: str) -> Column:
    """Six places, or whole units where the magnitude leaves no room for decimals."""
    return F.when(F.abs(col) < 1e5, rnd(col)).otherwise(rnd(col, 0))
