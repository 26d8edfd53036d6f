"""Dense date numbering and hash-derived integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelark.functions.windows import running


def hash_below(text: Column, bound: int | Column) -> Column:
    """Integer in [0, bound) from the first 32 bits of the md5 of a string."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), bound)


def calendar(df: DataFrame, column: str = "timestamp", out: str = "date_idx") -> DataFrame:
    """Distinct dates numbered from 0: one small row per date of the panel.

    The numbering is a running count over per-date rows, so even a calendar too
    long for one task is cut into ranges.
    """
    dates = df.select(column).distinct().withColumn("_all", F.lit(0))
    return running(dates, {out: F.lit(1)}, ["_all"], column).select(column, (F.col(out) - 1).cast("long").alias(out))
