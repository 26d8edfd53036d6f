"""Declared feature specifications."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPEC = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("lag", T.IntegerType()),
    ]
)

# fixed values: declared features with their lag, by category
DECLARED = {
    "returns": {"return_1d": 1, "return_5d": 5, "return_10d": 10, "return_20d": 20, "return_60d": 60},
    "price_structure": {
        "distance_from_sma_5": 1, "distance_from_sma_20": 1, "distance_from_sma_50": 1,
        "distance_from_sma_200": 1, "distance_from_52w_high": 1, "distance_from_52w_low": 1,
    },
    "momentum": {
        "rsi_14": 1, "macd": 1, "macd_signal": 1, "macd_hist": 1, "roc_5": 5, "roc_10": 10,
        "stoch_k": 1, "stoch_d": 1,
    },
    "volatility": {
        "std_5": 5, "std_10": 10, "std_20": 20, "std_60": 60, "downside_volatility_20": 20, "atr_14": 14,
    },
    "volume": {"volume_change": 1, "volume_zscore": 1, "obv": 1, "volume_price_trend": 1},
    "cross_asset": {
        "relative_return_vs_benchmark": 1, "market_relative_strength": 1, "rolling_beta": 20,
        "correlation_to_market": 20, "market_regime": 1,
    },
    "nlp": {
        "sentiment_1d": 1, "sentiment_3d_mean": 3, "sentiment_7d_mean": 7, "sentiment_30d_mean": 30,
        "sentiment_change": 1, "sentiment_acceleration": 2, "sentiment_zscore": 30,
        "positive_news_ratio": 5, "negative_news_ratio": 5, "risk_mentions": 5, "revenue_mentions": 5,
        "management_confidence": 5,
    },
    "nlp_indic": {"indic_sentiment_7d": 7, "indic_risk_mentions_7d": 7},
}


def declared_specs() -> list[dict]:
    return [
        {"name": name, "category": category, "lag": lag}
        for category, entries in DECLARED.items()
        for name, lag in entries.items()
    ]


def read_specs(path: str) -> list[dict]:
    """Specs from a YAML file with a ``features`` list of name, category and lag."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        listed = (yaml.safe_load(handle) or {}).get("features") or []
    return [s for s in listed if isinstance(s, dict) and s.get("name")] if isinstance(listed, list) else []


def filter_names(specs: Iterable[dict], available: Iterable[str]) -> list[str]:
    have = set(available)
    return [s["name"] for s in specs if s["name"] in have]


def spec_table(spark: SparkSession, specs: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([(s["name"], s.get("category"), s.get("lag")) for s in specs], SPEC)
