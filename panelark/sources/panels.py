"""Bar panels derived from the driver's tables, and the common panel reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars per supplier from unit prices of shipped lines.

    Open and close are the unit prices of the first and last line in
    (order, line) order, so they do not depend on file order. One hash
    aggregate, one exchange: the place of a line is one number, as a struct
    would make Spark sort all lines. Line numbers must be below 65,536 and
    order numbers below 2^47; others are an error.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    fits = order.between(-(1 << 46), (1 << 47) - 1) & line.between(0, 65535)
    wrong = F.raise_error(F.lit("order or line number out of range")).cast("long")
    place = F.when(~fits, wrong).otherwise(order.cast("long") * 65536 + line)
    return (
        lineitem.select(
            F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("symbol"),
            F.col("l_shipdate").alias("timestamp"),
            price.alias("p"),
            place.alias("place"),
            "l_quantity",
            "l_discount",
        )
        .groupBy("symbol", "timestamp")
        .agg(
            F.min_by("p", "place").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "place").alias("close"),
            F.sum("l_quantity").alias("volume"),
            (F.max("l_discount") * 10 - 0.5).alias("sentiment"),
        )
        .withColumns(
            {
                "positive_news": F.when(F.col("sentiment") > 0, 1.0).otherwise(0.0),
                "negative_news": F.when(F.col("sentiment") < 0, 1.0).otherwise(0.0),
            }
        )
    )


def event_bars(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Bars per user and time bucket from the event stream."""
    mood = (
        F.when(F.col("event_type").isin("purchase", "signup"), 1.0)
        .when(F.col("event_type") == "error", -1.0)
        .otherwise(0.0)
    )
    return (
        events.select(
            F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("symbol"),
            F.window("ts", width)["start"].alias("timestamp"),
            "ts",
            "value",
            mood.alias("mood"),
        )
        .groupBy("symbol", "timestamp")
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            F.avg("mood").alias("sentiment"),
        )
    )
