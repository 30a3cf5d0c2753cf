"""Broadcast hints behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows that are broadcast at most
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a DataFrame that is counted first; beyond ``rows`` Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
