"""Sides of a join that are broadcast only after their size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 200_000


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is (a shuffle join then)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
