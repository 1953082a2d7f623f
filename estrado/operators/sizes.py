"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
MOST = 100_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; as it is otherwise, so that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, source: DataFrame, times: int = 1, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if it can't have more than ``most`` rows: at most ``times`` for each row of ``source``, which is cheap to count."""
    return F.broadcast(df) if source.limit(most // times + 1).count() <= most // times else df
