"""Generated bars and headlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.functions.calendar import calendar, hash_below
from panelark.functions.text import lexicon_sentiment, mentions, script_of
from panelark.functions.windows import running
from panelark.schema import HEADLINES


def synthetic_bars(spark: SparkSession, days: int = 120, symbols: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Deterministic bars: drift plus a weekly shock, one row per calendar day."""
    names = F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")
    grid = spark.range(days).select(F.col("id").cast("int").alias("day"), names)
    tilt = F.when(F.col("symbol") == "A", 1.0).when(F.col("symbol") == "B", -0.5).otherwise(0.2)
    growth = 1 + 0.0008 * tilt + 0.002 * (F.col("day") % 7 - 3) / 3
    grid = running(grid, {"_path": growth}, order="day", how="product")
    close = 100.0 * F.col("_path")
    # the volume is cut to an integer every day, so it is folded over the days so far
    volume = F.aggregate(
        F.sequence(F.lit(0), F.col("day")),
        F.lit(1000).cast("long"),
        lambda v, d: (v * (1 + 0.02 * (d % 5 - 2))).cast("long"),
    )
    mood = (F.col("day") % 9 - 4) / 12
    start = F.lit("2024-01-01").cast("date")
    return grid.select(
        F.date_add(start, F.col("day")).cast("timestamp_ntz").alias("timestamp"),
        "symbol",
        F.round(close * 0.995, 4).alias("open"),
        F.round(close * 1.02, 4).alias("high"),
        F.round(close * 0.98, 4).alias("low"),
        F.round(close, 4).alias("close"),
        volume.alias("volume"),
        F.round(mood, 4).alias("sentiment"),
        F.greatest(mood, F.lit(0.0)).alias("positive_news"),
        F.greatest(-mood, F.lit(0.0)).alias("negative_news"),
    )


def synthetic_news(bars: DataFrame, seed: int = 42, every: int = 5) -> DataFrame:
    """One templated headline per bar on every fifth date of the calendar, scored from its text.

    Headlines are made where the symbol has a bar, which is what the join back
    to the bars keeps; there is no symbol x date grid to build.
    """
    dates = calendar(bars).where(F.col("date_idx") % every == 0).select("timestamp")
    pairs = bars.select("symbol", "timestamp").join(dates, "timestamp", "left_semi")
    day = F.date_format("timestamp", "yyyy-MM-dd")
    pick = hash_below(F.concat_ws("|", F.lit(str(seed)), "symbol", day), len(HEADLINES))
    template = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), (pick + 1).cast("int"))
    text = F.col("headline")
    out = pairs.withColumn("headline", F.replace(template, F.lit("{symbol}"), F.col("symbol")))
    out = out.withColumn("news_sentiment", lexicon_sentiment(text))
    score = F.col("news_sentiment")
    return out.withColumns(
        {
            "indic_risk_signal": mentions(text, "risk"),
            "positive_news": F.when(score > 0, 1.0).otherwise(0.0),
            "negative_news": F.when(score < 0, 1.0).otherwise(0.0),
            "risk_mentions": mentions(text, "risk"),
            "revenue_mentions": mentions(text, "revenue"),
            "management_confidence": F.greatest(score, F.lit(0.0)),
            "language": script_of(text),
        }
    )


def attach_news(bars: DataFrame, news: DataFrame) -> DataFrame:
    """Left join headlines on (timestamp, symbol); rows without news get sentiment 0."""
    slim = news.select("timestamp", "symbol", "news_sentiment", "headline")
    return bars.join(slim, ["timestamp", "symbol"], "left").fillna({"news_sentiment": 0.0})


