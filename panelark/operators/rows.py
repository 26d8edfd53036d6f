"""Row filters, projections, set operations and small helpers on panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.functions.calendar import calendar
from panelark.functions.windows import over_series
from panelark.schema import HOLIDAYS

CAP = 1.0e30


def sanitize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and NaN to 0, infinities and extremes to +/- 1e30."""

    def clean(c: str) -> Column:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.greatest(F.lit(-CAP), F.least(F.lit(CAP), x))

    return df.withColumns({c: clean(c) for c in columns if c in df.columns})


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def latest_session(df: DataFrame, date: str = "timestamp") -> DataFrame:
    """Rows at the last timestamp. The scalar subquery also prunes date partitions."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def session_of(df: DataFrame, day: str, date: str = "timestamp") -> DataFrame:
    return df.where(F.to_date(date) == F.lit(day).cast("date"))


def next_sessions(df: DataFrame, date: str = "timestamp") -> DataFrame:
    """Each trading day and the trading day after it."""
    days = df.select(F.to_date(date).alias("day")).distinct().withColumn("_all", F.lit(0))
    return over_series(
        days, lambda d, s: d.withColumn("next_day", s.lead("day")), keys=["_all"], order="day", after=1
    ).drop("_all")


def session_after(df: DataFrame, day: str, date: str = "timestamp") -> DataFrame:
    """One row: the first trading day after a given day, null if none."""
    later = df.select(F.to_date(date).alias("day")).where(F.col("day") > F.lit(day).cast("date"))
    return later.agg(F.min("day").alias("next_day"))


def active_dates(df: DataFrame, signal: str, date: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """Keep dates with any nonzero signal; keep every date if no date has one."""
    keys = list(by)
    marks = df.groupBy(*keys, date).agg(F.bool_or(F.coalesce(F.col(signal) != 0, F.lit(False))).alias("_active"))
    scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    kept = marks.withColumn("_some", F.max("_active").over(scope)).where(F.col("_active") | ~F.col("_some"))
    return df.join(kept.select(*keys, date), [*keys, date], "left_semi")


def rebalance_dates(df: DataFrame, signal: str, hold: int = 5, date: str = "timestamp") -> DataFrame:
    """Every ``hold``-th date of the calendar that has at least one signal."""
    signalled = df.where(F.col(signal).isNotNull()).select(date).distinct()
    dates = calendar(df, date).where(F.col("date_idx") % hold == 0)
    return dates.join(signalled, date, "left_semi")


def holiday_table(spark: SparkSession) -> DataFrame:
    kind = T.StructType([T.StructField("day", T.StringType())])
    return spark.createDataFrame([(d,) for d in HOLIDAYS], kind).select(F.col("day").cast("date"))


def trading_days(df: DataFrame, date: str = "timestamp") -> DataFrame:
    """Drop weekends and exchange holidays. The holiday list is a constant of about 90 rows."""
    open_days = df.where(~F.dayofweek(date).isin(1, 7)).withColumn("_day", F.to_date(date))
    holidays = holiday_table(df.sparkSession).withColumnRenamed("day", "_day")
    return open_days.join(F.broadcast(holidays), "_day", "left_anti").drop("_day")


def watchlist(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, "symbol", "left_semi")


def first_rows(
    df: DataFrame, n: int, keys: Sequence[str], order: str, descending: bool = False, limit: Column | None = None
) -> DataFrame:
    """The first ``n`` rows of each key in an order; ``limit`` may lower n per key.

    The constant bound on the row number lets Spark keep only n rows per key in
    each map task (WindowGroupLimit), so a very large key is reduced before the
    shuffle.
    """
    by = F.desc(order) if descending else F.asc(order)
    names = df.columns
    placed = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    kept = placed.where(F.col("_rn") <= n)
    if limit is not None:
        kept = kept.where(F.col("_rn") <= limit)
    return kept.select(*names)


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",), date: str = "timestamp") -> DataFrame:
    """The last ``n`` rows of each key."""
    return first_rows(df, n, keys, date, descending=True)


def top_rows(df: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols only in one of two panels, and those in both, with a label."""
    a, b = before.select("symbol").distinct(), after.select("symbol").distinct()
    gone = a.exceptAll(b).withColumn("change", F.lit("missing"))
    new = b.exceptAll(a).withColumn("change", F.lit("new"))
    both = a.intersect(b).withColumn("change", F.lit("kept"))
    return gone.unionByName(new).unionByName(both)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first in an explicit order. A partial aggregate that leaves one row a key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def seeded_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Sample of ``n`` rows without replacement, fixed by key hash and seed.

    ``orderBy.limit`` keeps n rows per task and merges them, there is no full sort.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_mark", mark).orderBy("_mark", *keys).limit(n).drop("_mark")


def wide_by_symbol(df: DataFrame, value: str, symbols: Sequence[str], date: str = "timestamp") -> DataFrame:
    """Pivot to one column per symbol; the column list is given, so no extra pass finds it."""
    return df.groupBy(date).pivot("symbol", list(symbols)).agg(F.first(value, ignorenulls=True))


def long_by_symbol(df: DataFrame, symbols: Sequence[str], value: str, date: str = "timestamp") -> DataFrame:
    return df.unpivot([date], list(symbols), "symbol", value).dropna(subset=[value])

