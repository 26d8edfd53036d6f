"""Price, momentum, volatility and volume features of one entity's series.

Each ``add_*`` step takes a frame and the :class:`Series` windows and adds
columns; ``price_features`` chains them so that all windows share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelark.functions.skew import checked_once
from panelark.functions.windows import (
    Means,
    Series,
    over_series,
    ratio,
    running,
    zero_null,
)
from panelark.schema import TARGET

RETURN_SPANS = (1, 5, 10, 20, 60)
SMA_SPANS = (5, 20, 50, 200)
STD_SPANS = (5, 10, 20, 60)
YEAR_ROWS = 252


def with_ohlc(df: DataFrame) -> DataFrame:
    """Missing open, high or low columns (or values) take the close."""
    fill = {}
    for name in ("open", "high", "low"):
        fill[name] = F.coalesce(F.col(name), F.col("close")) if name in df.columns else F.col("close")
    return df.withColumns(fill)


def add_returns(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumns({f"return_{n}d": zero_null(s.change("close", n)) for n in RETURN_SPANS})


def add_moving_averages(df: DataFrame, s: Series) -> DataFrame:
    df = df.withColumns({f"sma_{n}": s.mean("close", n) for n in SMA_SPANS})
    gap = {n: zero_null(ratio("close", f"sma_{n}") - 1) for n in SMA_SPANS}
    return df.withColumns(
        {f"distance_from_sma_{n}": gap[n] for n in SMA_SPANS} | {f"norm_sma_{n}": gap[n] for n in SMA_SPANS}
    )


def add_volatility(df: DataFrame, s: Series) -> DataFrame:
    """Needs ``return_1d``. The downside series keeps its first value missing."""
    df = df.withColumns({f"std_{n}": zero_null(s.std("return_1d", n)) for n in STD_SPANS})
    falls = F.when(s.lag("close").isNotNull(), F.least(s.change("close"), F.lit(0.0)))
    df = df.withColumns({f"norm_std_{n}": F.col(f"std_{n}") for n in STD_SPANS} | {"_falls": falls})
    return df.withColumn("downside_volatility_20", zero_null(s.std("_falls", 20))).drop("_falls")


def add_oscillators(df: DataFrame, rsi: int | None = 14, macd: tuple[int, int, int] | None = (12, 26, 9)) -> DataFrame:
    """Relative strength index and moving average convergence; both share one sort for their means."""
    columns, alphas, specs, later = [], [], [], []
    if rsi:
        df = over_series(df, lambda d, s: d.withColumn("_move", F.col("close") - s.lag("close")), before=1)
        # greatest and least skip null, but the first move must stay missing
        known = F.col("_move").isNotNull()
        df = df.withColumns(
            {
                "_up": F.when(known, F.greatest(F.col("_move"), F.lit(0.0))),
                "_down": F.when(known, -F.least(F.col("_move"), F.lit(0.0))),
            }
        )
        columns.append("_move")
        alphas.append(1 / rsi)
        specs += [("_mean_up", "_up", 1 / rsi, rsi, "_move"), ("_mean_down", "_down", 1 / rsi, rsi, "_move")]
    if macd:
        fast, slow, signal = (2 / (n + 1) for n in macd)
        columns.append("close")
        alphas += [fast, slow, signal]
        specs += [("_fast", "close", fast, 0, "close"), ("_slow", "close", slow, 0, "close")]
        later = [("_signal", "_line", signal, 0, "close")]
    means = Means()
    df = means.add(means.prepare(df, columns, alphas), specs)
    if macd:
        df = means.add(df.withColumn("_line", F.col("_fast") - F.col("_slow")), later)
        price = F.nullif(F.col("close"), F.lit(0.0))
        df = df.withColumns(
            {
                "raw_macd": zero_null("_line"),
                "macd": zero_null(zero_null("_line") / price),
                "macd_signal": zero_null(zero_null("_signal") / price),
                "macd_hist": zero_null(zero_null(F.col("_line") - F.col("_signal")) / price),
            }
        )
    if rsi:
        index = 100 - 100 / (1 + ratio("_mean_up", "_mean_down"))
        df = df.withColumn(f"rsi_{rsi}", zero_null(index, 50.0))
    used = ["_move", "_up", "_down", "_mean_up", "_mean_down", "_fast", "_slow", "_line", "_signal"]
    return means.finish(df).drop(*used)


def add_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    return add_oscillators(df, n, None)


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return add_oscillators(df, None, (fast, slow, signal))


def true_range(s: Series) -> Column:
    before = s.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )


def add_atr(df: DataFrame, s: Series, n: int = 14) -> DataFrame:
    df = df.withColumn("_range_now", true_range(s))
    df = df.withColumn(f"atr_{n}", zero_null(s.mean("_range_now", n)))
    return df.withColumn(f"norm_atr_{n}", zero_null(ratio(f"atr_{n}", "close"))).drop("_range_now")


def add_stochastic(df: DataFrame, s: Series, n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = s.lowest("low", n), s.highest("high", n)
    df = df.withColumn("_k", 100 * ratio(F.col("close") - low, high - low))
    return df.withColumns(
        {"stoch_k": zero_null("_k", 50.0), "stoch_d": zero_null(s.mean("_k", smooth), 50.0)}
    ).drop("_k")


def add_momentum(df: DataFrame, s: Series) -> DataFrame:
    """Needs the return columns."""
    spans = (5, 10, 20)
    rate = {f"roc_{n}": F.col(f"return_{n}d") * 100 for n in spans}
    alias = {f"momentum_{n}": F.col(f"return_{n}d") for n in spans}
    year = {"momentum_12_1": zero_null(ratio(s.lag("close", 21), s.lag("close", 252)) - 1)}
    return df.withColumns(rate | alias | year)


def add_extremes(df: DataFrame, s: Series) -> DataFrame:
    """Distances from the extremes of a year: of short frames, then of those frames a step apart.

    A row thus compares about two roots of the year's rows instead of all of them.
    """
    step = math.isqrt(YEAR_ROWS) + 1
    back = [*range(0, YEAR_ROWS - step, step), YEAR_ROWS - step]
    df = df.withColumns({"_high_part": s.highest("high", step), "_low_part": s.lowest("low", step)})
    high = F.greatest(*[s.lag("_high_part", n) for n in back])
    low = F.least(*[s.lag("_low_part", n) for n in back])
    return df.withColumns(
        {
            "distance_from_52w_high": zero_null(ratio("close", high) - 1),
            "distance_from_52w_low": zero_null(ratio("close", low) - 1),
        }
    ).drop("_high_part", "_low_part")


def add_volume(df: DataFrame, s: Series) -> DataFrame:
    score = ratio(F.col("volume") - s.mean("volume", 20, 5), s.std("volume", 20, 5))
    return df.withColumns(
        {"volume_change": zero_null(s.change("volume")), "volume_zscore": zero_null(score)}
    )


def add_label(df: DataFrame, s: Series) -> DataFrame:
    """Return from the next open to the open five rows later."""
    return df.withColumn(TARGET, ratio(s.lead("open", 6), s.lead("open", 1)) - 1)


def add_volume_flows(df: DataFrame) -> DataFrame:
    """Cumulative signed volume, volume-price trend and its 20-row relative change."""

    def steps(d: DataFrame, s: Series) -> DataFrame:
        sign = zero_null(F.signum(F.col("close") - s.lag("close")))
        return d.withColumns(
            {
                "_signed": sign * F.col("volume"),
                "_trend": zero_null(s.change("close")) * F.col("volume"),
            }
        )

    def relative(d: DataFrame, s: Series) -> DataFrame:
        past = s.lag("volume_price_trend", 20)
        return d.withColumn(
            "norm_vpt_20d", zero_null((F.col("volume_price_trend") - past) / (F.abs(past) + 1e-6))
        )

    df = over_series(df, steps, before=1)
    df = running(df, {"obv": F.col("_signed"), "volume_price_trend": F.col("_trend")})
    return over_series(df, relative, before=20).drop("_signed", "_trend")


# steps with carried state work on whole frames; they run first, while the rows are narrow
CARRIED_STEPS = [add_oscillators, add_rsi, add_macd]
BOUNDED_STEPS = [
    add_returns,
    add_moving_averages,
    add_volatility,
    add_atr,
    add_stochastic,
    add_momentum,
    add_extremes,
    add_volume,
    add_label,
]


def price_features(df: DataFrame, steps=None) -> DataFrame:
    """All price features; ``steps`` narrows them to a subset without the volume flows."""
    chosen = [add_oscillators, *BOUNDED_STEPS] if steps is None else steps
    bounded = [step for step in chosen if step not in CARRIED_STEPS]

    def bounded_columns(d: DataFrame, s: Series) -> DataFrame:
        for step in bounded:
            d = step(d, s)
        return d

    def build() -> DataFrame:
        out = with_ohlc(df)
        for step in chosen:
            if step in CARRIED_STEPS:
                out = step(out)
        if bounded:
            out = over_series(out, bounded_columns, before=YEAR_ROWS, after=6)
        return add_volume_flows(out) if steps is None and "volume" in df.columns else out

    return checked_once(df, ["symbol"], "timestamp", build)
