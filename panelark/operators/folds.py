"""Chronological folds, embargo and holdout over the dates of a panel.

All tables here have one row per date (or per fold and date); their size is the
length of the calendar, not of the panel. They are joined to the panel on the
date, and the join method is left to the runtime size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelark.functions.calendar import calendar



def split_place(idx: Column, total: Column, parts: int | Column) -> Column:
    """Part of position ``idx`` when ``total`` items are split as evenly as possible, longer parts first."""
    size = F.floor(total / parts)
    longer = total % parts
    head = longer * (size + 1)
    return (
        F.when(idx < head, F.floor(idx / (size + 1)))
        .otherwise(longer + F.floor((idx - head) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def chunk_of(dates: DataFrame, parts: int, adapt: bool = False) -> DataFrame:
    """Add ``n_dates`` and ``chunk``. With ``adapt`` a short calendar gets fewer parts."""
    sized = dates.withColumn("n_dates", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    total = F.col("n_dates")
    used = F.lit(parts)
    if adapt:
        used = F.when(total < 2 * parts, F.greatest(F.lit(2), F.floor(total / 4))).otherwise(F.lit(parts)).cast("int")
    return sized.withColumn("n_chunks", used).withColumn(
        "chunk", split_place(F.col("date_idx"), total, F.col("n_chunks"))
    )


def fold_dates(
    df: DataFrame,
    splits: int = 6,
    embargo: int = 6,
    expanding: bool = True,
    least_embargo: int = 6,
    date: str = "timestamp",
) -> DataFrame:
    """(fold, role, date) rows of an embargoed walk-forward.

    Fold i tests on chunk i and trains on the dates before it (or on the chunk
    before it), dropping dates closer than ``embargo`` positions to the test.
    If nothing is left the unpurged dates are used.
    """
    gap = max(embargo, least_embargo)
    dates = chunk_of(calendar(df, date), splits, adapt=True)
    starts = dates.groupBy("chunk").agg(F.min("date_idx").alias("test_start")).where("chunk > 0")
    starts = starts.withColumnRenamed("chunk", "fold")
    test = dates.where("chunk > 0").select(F.col("chunk").alias("fold"), F.lit("test").alias("role"), date, "date_idx")
    # at most one row per fold on one side, so the condition join is folds x dates by definition
    earlier = F.col("chunk") < F.col("fold") if expanding else F.col("chunk") == F.col("fold") - 1
    raw = dates.join(F.broadcast(starts), earlier)
    kept = F.col("date_idx") < F.greatest(F.lit(0), F.col("test_start") - gap)
    per_fold = Window.partitionBy("fold")
    train = (
        raw.withColumn("_kept", kept)
        .withColumn("_any", F.max(F.col("_kept")).over(per_fold))
        .where(F.col("_kept") | ~F.col("_any"))
        .select("fold", F.lit("train").alias("role"), date, "date_idx")
    )
    return train.unionByName(test)


def holdout_split(df: DataFrame, months: int = 9, share: float = 0.80, date: str = "timestamp") -> DataFrame:
    """Dates labelled ``validation`` or ``holdout``.

    A calendar of a year or more with over 30 dates holds out its last months;
    a shorter one holds out the dates from position max(2, 80%) on.
    """
    dates = chunk_of(calendar(df, date), 1)
    whole = Window.partitionBy(F.lit(0))
    last, first = F.max(date).over(whole), F.min(date).over(whole)
    long = (F.datediff(last, first) >= 365) & (F.col("n_dates") > 30)
    part_day = last - last.cast("date").cast("timestamp_ntz")
    by_month = F.add_months(last.cast("date"), -months).cast("timestamp_ntz") + part_day
    by_share = F.col("date_idx") >= F.greatest(F.lit(2), F.floor(F.col("n_dates") * share))
    held = F.when(long, F.col(date) >= by_month).otherwise(by_share)
    return dates.select(date, "date_idx", F.when(held, "holdout").otherwise("validation").alias("part"))
