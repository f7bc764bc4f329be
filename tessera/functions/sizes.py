"""Sides of joins that go to every task, behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side has at most.
MOST_ROWS = 50_000


def broadcast_small(side: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``side``, for every task if it has ``most`` rows or fewer; a larger one is joined as the optimizer sees fit.

    Counting stops at ``most``. For sides that are cheap to make, as they are made twice.
    """
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
