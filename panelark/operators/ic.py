"""Rank information coefficients and their inference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.functions.calendar import calendar
from panelark.functions.ranks import average_rank, pair_ranks, places
from panelark.functions.skew import balanced, fits_a_task, hot_groups, is_balanced, is_large
from panelark.functions.stats import bootstrap_mean_ci, newey_west
from panelark.functions.windows import safe_corr
from panelark.operators.folds import chunk_of
from panelark.schema import TARGET
from panelark.session import cut_lineage, written


def finite(c: str):
    """The value, or null when it is missing, NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def long_features(df: DataFrame, features: Sequence[str], target: str = TARGET, date: str = "timestamp") -> DataFrame:
    """(date, feature, x, y) rows: all features are evaluated in one pass, not one job each."""
    wide = df.select(date, finite(target).alias("y"), *[finite(f).alias(f) for f in features])
    return wide.where(F.col("y").isNotNull()).unpivot([date, "y"], list(features), "feature", "x").dropna(subset=["x"])


def rank_correlation(df: DataFrame, x: str, y: str, groups: Sequence[str]) -> DataFrame:
    """Spearman correlation per group with group size; null on a constant side.

    Twelve digits are kept, so a correlation of zero has no sign.
    """
    both = df.select(*groups, F.col(x).alias("x"), F.col(y).alias("y"))
    clean = both.dropna(subset=["x", "y"])
    # the groups are counted once, with the rows that are dropped, so the values need not be worked out for it
    hot = hot_groups(both, groups)
    if hot is None:
        with balanced(groups):
            ranked = _ranked_pairs(clean, groups)
    elif all(isinstance(clean.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in ("x", "y")):
        clean = clean.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
        ranked = pair_ranks(clean, groups, hot)
    else:
        ranked = _ranked_pairs(clean, groups)
    corr = safe_corr(F.col("rx"), F.col("ry"))
    # ranks differ where values do
    moves = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(moves, F.round(corr, 12)).alias("ic"))


def _ranked_pairs(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Ranks rx and ry of x and y in their groups.

    A hot group reads its rows for the ranges, their sizes and the ranks, so the
    ranks of one side are written before the other side is split.
    """
    one = average_rank(pairs, "x", "rx", groups).select(*groups, "rx", "y")
    if not is_balanced(groups) and is_large(one):
        one = written(one, "ranks")
    return average_rank(one, "y", "ry", groups)


def daily_rank_ic(
    df: DataFrame, pred: str, target: str = TARGET, date: str = "timestamp", by: Sequence[str] = ()
) -> DataFrame:
    """Per-date Spearman correlation; dates with under 3 rows or a constant side are left out."""
    out = rank_correlation(df, pred, target, [*by, date])
    return out.where((F.col("n") >= 3) & F.col("ic").isNotNull()).select(*by, date, "ic")


def _spearman(x: np.ndarray, y: np.ndarray, placed: np.ndarray) -> float:
    """Rank correlation of the rows with x; ``placed`` are the ranks of all y. NaN below 3 rows or on a constant side."""
    known = ~np.isnan(x)
    if not known.all():
        x, y = x[known], y[known]
        placed = places(y)
    if len(x) < 3 or x.min() == x.max() or y.min() == y.max():
        return np.nan
    a, b = places(x) - (len(x) + 1) / 2, placed - (len(x) + 1) / 2
    return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12) + 0.0


def _of_date(names: Sequence[str], date: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["_y"].to_numpy()
        placed = places(y)
        values = [_spearman(rows[f"_x{i}"].to_numpy(), y, placed) for i in range(len(names))]
        return pd.DataFrame({"feature": list(names), date: rows[date].iloc[0], "ic": values})

    return run


def feature_rank_ic(df: DataFrame, features: Sequence[str], target: str = TARGET, date: str = "timestamp") -> DataFrame:
    """(feature, date, ic): ``daily_rank_ic`` of many features from wide rows.

    A row is shuffled once for all features and the label is ranked once a date.
    Dates too large for a task are ranked as long rows, range by range.
    """
    if not fits_a_task(df.select(date), [date], len(features) + 1):
        return daily_rank_ic(long_features(df, features, target, date), "x", "y", date=date, by=["feature"])
    wide = df.select(date, finite(target).alias("_y"), *[finite(f).alias(f"_x{i}") for i, f in enumerate(features)])
    rows = wide.where(F.col("_y").isNotNull() & F.col(date).isNotNull())
    kind = df.schema[date].dataType.simpleString()
    out = rows.groupBy(date).applyInPandas(_of_date(features, date), f"feature string, `{date}` {kind}, ic double")
    return out.where(F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_inference(series: DataFrame, by: Sequence[str] = (), value: str = "ic", date: str = "timestamp") -> DataFrame:
    """Mean, Newey-West error and t, and bootstrap interval per series."""
    keys = list(by)
    series = cut_lineage(series.select(*keys, date, value))
    base = newey_west(series, value, date, keys)
    interval = bootstrap_mean_ci(series, value, date, keys, materialize=False)
    if keys:
        return base.join(interval, keys)
    return base.withColumn("_k", F.lit(0)).join(interval.withColumn("_k", F.lit(0)), "_k").drop("_k")


def ic_statistics(daily: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, median, deviation, ratio and share of positive daily ICs."""
    stats = daily.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"),
        F.median("ic").alias("median_ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(1e-4)).alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive_ic"),
    )
    return stats.withColumn("icir", F.col("mean_ic") / (F.col("ic_std") + 1e-6))


def pooled_rank_ic(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """One Spearman correlation over all rows of a group."""
    keys = list(groups)
    source = df if keys else df.withColumn("_all", F.lit(0))
    out = rank_correlation(source, x, y, keys or ["_all"])
    return out.select(*keys, "n", F.coalesce("ic", F.lit(0.0)).alias("ic"))


def pearson_ic(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with missing and infinite values read as 0."""
    fx, fy = (F.coalesce(finite(c), F.lit(0.0)) for c in (x, y))
    return df.groupBy(*by).agg(F.coalesce(safe_corr(fx, fy), F.lit(0.0)).alias("ic"))


def ic_by_year(daily: DataFrame, by: Sequence[str] = (), date: str = "timestamp") -> DataFrame:
    return daily.groupBy(*by, F.year(date).alias("year")).agg(F.avg("ic").alias("ic"))


def product_series(df: DataFrame, pred: str, actual: str, order: str) -> DataFrame:
    """Standardised product of two demeaned columns, one value per row in row order."""
    clean = df.select(order, finite(pred).alias("p"), finite(actual).alias("a")).dropna()
    moments = clean.agg(F.avg("p").alias("mp"), F.avg("a").alias("ma"),
                        (F.stddev_pop("p") * F.stddev_pop("a")).alias("sd"))
    spread = moments.select("sd").scalar() + 1e-8
    value = (F.col("p") - moments.select("mp").scalar()) * (F.col("a") - moments.select("ma").scalar()) / spread
    return clean.select(order, value.alias("ic"))


def stability(
    long: DataFrame, dates: DataFrame | None = None, date: str = "timestamp", chunks: int = 4
) -> DataFrame:
    """1 - deviation / mean size of the pooled IC over chronological chunks, in [0, 1].

    ``long`` holds (date, feature, x, y) rows. Chunks of at most five rows are
    skipped; a calendar shorter than two dates per chunk gives 1.
    """
    numbered = chunk_of(calendar(long, date) if dates is None else dates, chunks)
    # one row per date; of known size, so the long rows are not shuffled to meet it
    placed = long.join(written(numbered.select(date, "chunk", "n_dates"), "chunks"), date)
    pooled = rank_correlation(placed.withColumn("few", F.col("n_dates") < 2 * chunks), "x", "y", ["feature", "few", "chunk"])
    ic = F.when(F.col("n") > 5, F.coalesce("ic", F.lit(0.0)))
    stats = pooled.groupBy("feature", "few").agg(F.avg(F.abs(ic)).alias("size"), F.stddev_pop(ic).alias("sd"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("sd") / (F.col("size") + 1e-6)))
    score = F.when(F.col("few"), 1.0).when(F.col("size") > 0, score).otherwise(0.0)
    return stats.select("feature", score.alias("stability"))
