"""Writers for bars, signals, summaries and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_FILE_ROWS = 5_000_000


def write_sorted(df: DataFrame, path: str, order: Sequence[str], by: Sequence[str] = (), fmt: str = "parquet", file_rows: int = MAX_FILE_ROWS) -> None:
    """A table clustered by ranges of ``order``, sorted within each file, in folders by ``by``.

    Ranges are cut by the sizes of the data: a heavy folder is written by many
    tasks into many files of neighbouring rows, small ones share a task. A read
    with a condition on a leading column skips folders, files and row groups.
    """
    keys = [*by, *[c for c in order if c not in by]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ranged.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(*by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", file_rows: int = MAX_FILE_ROWS, unit: str = "day") -> None:
    """Bars in one folder per date, sorted by symbol and time within each file.

    A long history of few bars a day is better kept by ``unit`` month or year; ``date`` is then the first day of it.
    """
    date = F.to_date(F.date_trunc(unit, "timestamp"))
    write_sorted(bars.withColumn("date", date), path, ["symbol", "timestamp"], ["date"], fmt, file_rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_signals(signals: DataFrame, path: str) -> None:
    """Replace only the dates present in ``signals``; other dates stay."""
    dated = signals.withColumn("signal_day", F.to_date("signal_date"))
    (
        dated.repartition("signal_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("signal_day")
        .parquet(path)
    )


def latest_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals of the last date: the date is a partition, so only its files are read."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("signal_day") == stored.agg(F.max("signal_day")).scalar()).drop("signal_day")


def write_summary(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per result."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
