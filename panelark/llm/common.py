"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.session import scratch_path

ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that reach Python workers by rows and bytes."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it back.

    The table survives lost executors, and what made it runs once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under private names, so that no other column clashes."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{folder}/documents.parquet")


def bucket(column: str, bits: int) -> Column:
    """The bit of a fixed-size bitmap that a 64-bit hash falls on."""
    return F.shiftrightunsigned(F.col(column), 64 - bits)
