"""Numbers as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_SIZE = "规模未知"


def approximate(value: Column) -> Column:
    """``约 N``: exact below 10, then down to tens, fifties (from 100) and hundreds (from 1000)."""
    step = F.when(value < 10, 1).when(value < 100, 10).when(value < 1000, 50).otherwise(100)
    return F.concat(F.lit("约 "), (F.floor(value / step) * step).cast("long").cast("string"))


def size_display(items: Column, pages: Column, method: Column) -> Column:
    shown = F.concat(approximate(items), F.lit("条"), F.when(F.coalesce(pages, F.lit(0)) > 0, F.concat(F.lit("、"), approximate(pages), F.lit("页"))).otherwise(F.lit("")), F.lit("（据"), method, F.lit("）"))
    return F.when(items.isNull() | (method == "未知"), F.lit(UNKNOWN_SIZE)).otherwise(shown)
