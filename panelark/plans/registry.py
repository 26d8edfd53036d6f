"""Registry of named queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.session import configure
from panelark.sources.panels import daily_bars, event_bars, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Results are compared by value. Sums of doubles differ in the last bits between
# engines, so doubles are rounded after the last step; the small shift keeps
# exact decimal halves away from the rounding boundary.
SHIFT = "1.7e-9"


class Tables:
    """Lazy access to the input tables and the two bar panels built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def bars(self) -> DataFrame:
        return daily_bars(self["lineitem"])

    @property
    def ticks(self) -> DataFrame:
        return event_bars(self["events"])


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under a name, with the SQL that must agree."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def tidy(df: DataFrame, digits: int = 6, special: dict[str, int] | None = None) -> DataFrame:
    """Round the double columns of a result; ``special`` sets digits per column."""
    places = special or {}
    shown = [
        (F.round(F.col(f"`{f.name}`") + float(SHIFT), places.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*shown)


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL counterpart of ``tidy`` for one expression."""
    return f"round(({expr})::DOUBLE + {SHIFT}, {digits}) + 0e0 AS {name or expr}"


def RS(names: str, digits: int = 6) -> str:
    return ", ".join(R(n, n, digits) for n in names.split())


BARS_CTE = """bars AS (
  SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate AS "timestamp",
         min({'k': l_orderkey, 'n': l_linenumber, 'p': l_extendedprice / l_quantity}).p AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         max({'k': l_orderkey, 'n': l_linenumber, 'p': l_extendedprice / l_quantity}).p AS close,
         sum(l_quantity) AS volume, max(l_discount) * 10::DOUBLE - 0.5::DOUBLE AS sentiment,
         CASE WHEN max(l_discount) * 10::DOUBLE - 0.5::DOUBLE > 0 THEN 1e0 ELSE 0e0 END AS positive_news,
         CASE WHEN max(l_discount) * 10::DOUBLE - 0.5::DOUBLE < 0 THEN 1e0 ELSE 0e0 END AS negative_news
  FROM lineitem GROUP BY 1, 2)"""

TICKS_CTE = """ticks AS (
  SELECT 'U' || lpad(user_id::VARCHAR, 6, '0') AS symbol, time_bucket(INTERVAL 6 HOUR, ts) AS "timestamp",
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         count(*)::DOUBLE AS volume,
         avg(CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 WHEN event_type = 'error' THEN -1e0
                  ELSE 0e0 END) AS sentiment
  FROM events GROUP BY 1, 2)"""
