"""Portfolio backtests on long (strategy, date, symbol) frames.

No date x symbol matrix is built. Prices at later calendar positions come from
range frames over the dense date index; turnover comes from adding the new
weights and the drifted old weights per symbol.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelark.functions.normal import normal_cdf, normal_quantile
from panelark.functions.ranks import average_rank
from panelark.functions.skew import balanced, row_limit
from panelark.functions.stats import sharpe_difference
from panelark.functions.windows import Series, clip, over_series, per_group, running
from panelark.operators.ic import finite
from panelark.operators.rows import active_dates
from panelark.schema import COST_LEVELS_BPS, ONE_WAY_BPS, TARGET, TRIAL_COUNTS
from panelark.session import written

YEAR = 252.0
NAMED_PREDICTIONS = ("prediction", "prediction_full", "prediction_ohlcv", "prediction_ablated")
EQUAL_WEIGHT = "eq_weight_signal"
RULES = [EQUAL_WEIGHT, "mom_12_1_signal", "reversal_5d_signal", "reversal_lowturnover_signal"]
DATE_KEYS = ["strategy", "timestamp"]
SENT_ROWS = 1_000_000  # of a table that is sent to every task


def rule_signals(df: DataFrame) -> DataFrame:
    """(strategy, timestamp, symbol, open, signal, target) rows for the four rule strategies."""
    return long_signals(rule_columns(df), RULES)


def rule_columns(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The rows with the rule strategies' signals in columns, and ``more`` columns as they are."""
    r5 = F.col("return_5d")
    momentum = next((F.col(c) for c in ("momentum_12_1", "return_60d", "return_5d") if c in df.columns), F.lit(0.0))
    year = F.col("momentum_12_1") if "momentum_12_1" in df.columns else F.lit(0.0)
    return df.select(
        "timestamp",
        "symbol",
        "open",
        (F.col(TARGET) if TARGET in df.columns else F.lit(None).cast("double")).alias(TARGET),
        F.lit(1.0).alias("eq_weight_signal"),
        momentum.alias("mom_12_1_signal"),
        (-r5).alias("reversal_5d_signal"),
        (-0.7 * r5 + 0.3 * year).alias("reversal_lowturnover_signal"),
        *more,
    )


def long_signals(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Unpivot signal columns to (strategy, signal) rows."""
    ids = ["timestamp", "symbol", "open"] + ([TARGET] if TARGET in df.columns else [])
    typed = df.select(*ids, *[F.col(s).cast("double").alias(s) for s in signals])
    return typed.unpivot(ids, list(signals), "strategy", "signal")


def usable_rows(signals: DataFrame, filter_inactive: bool = True) -> DataFrame:
    """Rows with price and signal; named prediction strategies lose their all-zero dates."""
    kept = signals.dropna(subset=["strategy", "timestamp", "symbol", "open", "signal"])
    if not filter_inactive:
        return kept
    named = F.col("strategy").isin(*NAMED_PREDICTIONS)
    probe = kept.withColumn("_probe", F.when(named, F.col("signal")).otherwise(1.0))
    return active_dates(probe, "_probe", by=["strategy"]).drop("_probe")


def date_indices(rows: DataFrame) -> DataFrame:
    """(strategy, timestamp, date_idx): the dates each strategy has left, numbered."""
    # one row per strategy and date, read with the rows by every step
    days = written(rows.select(*DATE_KEYS).distinct(), "strategy-dates")
    dates = running(days, {"_n": F.lit(1)}, ["strategy"], "timestamp")
    return dates.select(*DATE_KEYS, (F.col("_n") - 1).cast("long").alias("date_idx"))


def with_date_index(rows: DataFrame) -> DataFrame:
    """Number the dates each strategy has left."""
    return rows.join(date_indices(rows), DATE_KEYS)


def forward_returns(rows: DataFrame, hold: int = 5) -> DataFrame:
    """Open-to-open return from the next calendar date over ``hold`` dates.

    Positions are those of the calendar: a symbol without a row on either date
    has no return. A range frame of one position finds the row, with no join.
    """

    def build(d: DataFrame, s: Series) -> DataFrame:
        def at(k: int) -> Column:
            return F.first("open").over(s.ordered.rangeBetween(k, k))

        return d.withColumn("fwd", F.try_divide(at(1 + hold), at(1)) - 1)

    return over_series(rows, build, keys=["strategy", "symbol"], order="date_idx", after=hold + 1)


def rebalance_returns(rows: DataFrame, hold: int = 5) -> DataFrame:
    """``forward_returns`` of the rebalance dates alone.

    Their prices are those of the date after each of them and after the next one, so no
    other row is shuffled.
    """
    place = F.col("date_idx") % hold
    return forward_returns(rows.where((place == 0) | (place == 1 % hold)), hold).where(place == 0)


def target_weights(rows: DataFrame, top_k: int = 20) -> DataFrame:
    """Equal weights for flat signals, else equal weights over average rank <= top_k."""
    spread = rows.groupBy(*DATE_KEYS).agg((F.min("signal") < F.max("signal")).alias("_moves"))
    flat = spread.groupBy("strategy").agg((~F.max(F.col("_moves"))).alias("_flat"))
    flat = flat.withColumn("_flat", F.col("_flat") | (F.col("strategy") == EQUAL_WEIGHT))
    ranked = average_rank(rows, "signal", "_place", DATE_KEYS, descending=True)
    # one row per strategy, a list the caller writes down
    picked = ranked.join(F.broadcast(flat), "strategy").withColumn("_in", F.col("_flat") | (F.col("_place") <= top_k))
    counted = per_group(picked, DATE_KEYS, {"_held": F.count(F.when(F.col("_in"), 1))})
    weight = F.when(F.col("_in"), 1.0 / F.col("_held")).otherwise(0.0)
    return counted.withColumn("weight", weight).drop("_place", "_in", "_held", "_flat")


def period_returns(weights: DataFrame, hold: int = 5) -> DataFrame:
    """Per strategy and rebalance date: gross return and turnover against drifted weights.

    Each holding is emitted twice: as the new weight of its date and, drifted by
    its return, as the old weight of the next one. Adding both per symbol gives
    the trade, with no join of a date to the date before. Rows without weight
    only mark their date and collapse before the shuffle.
    """
    fwd, weight = F.coalesce("fwd", F.lit(0.0)), F.col("weight")
    rows = weights.withColumns(
        {
            "period": F.floor(F.col("date_idx") / hold),
            "_after": F.greatest(weight * (1.0 + fwd), F.lit(0.0)),
        }
    )
    rows = per_group(rows, DATE_KEYS, {"_total": F.sum("_after")})
    drift = F.when(F.col("_total") > 0, F.col("_after") / F.col("_total")).otherwise(weight)
    gross = F.coalesce(weight * F.col("fwd"), F.lit(0.0))

    def entry(period: Column, date: Column, change: Column, part: Column) -> Column:
        return F.struct(period.alias("period"), date.alias("timestamp"), change.alias("change"), part.alias("gross"))

    now = entry(F.col("period"), F.col("timestamp"), weight, gross)
    later = entry(F.col("period") + 1, F.lit(None).cast("timestamp_ntz"), -drift, F.lit(0.0))
    both = F.array_compact(F.array(now, F.when(weight > 0, later)))
    moved = rows.select("strategy", F.when(weight > 0, F.col("symbol")).alias("symbol"), F.inline(both))
    trades = moved.groupBy("strategy", "period", "symbol").agg(
        F.max("timestamp").alias("timestamp"), F.abs(F.sum("change")).alias("change"), F.sum("gross").alias("gross")
    )
    out = trades.groupBy("strategy", "period").agg(
        F.max("timestamp").alias("timestamp"), F.sum("gross").alias("gross"), F.sum("change").alias("turnover")
    )
    # the old weights of the last date have no next date
    return out.where(F.col("timestamp").isNotNull()).select("strategy", "timestamp", "period", "gross", "turnover")


def held_positions(rows: DataFrame, dates: DataFrame, flat: Sequence[str], hold: int, top_k: int, small: bool = True) -> DataFrame:
    """``target_weights`` of ``rebalance_returns`` where the weight is not 0, and a row without symbol for each rebalance date.

    Names outside the ``top_k`` of a date are left out before the shuffle, and
    prices are looked up for the picked names alone; ``flat`` strategies hold all.
    ``small`` says that the picked names of all ``dates`` may be sent to every task.
    """
    columns = [*DATE_KEYS, "symbol", "date_idx", "fwd", "weight"]
    weight = (1.0 / F.col("_held")).alias("weight")
    nobody, unpriced = (F.lit(None).cast(rows.schema[c].dataType) for c in ("symbol", "open"))
    marks = dates.where(F.col("date_idx") % hold == 0)
    marks = marks.select(*DATE_KEYS, nobody.alias("symbol"), "date_idx", unpriced.alias("fwd"), F.lit(0.0).alias("weight"))

    moving = rows.where(~F.col("strategy").isin(list(flat)))
    first = F.rank().over(Window.partitionBy(*DATE_KEYS).orderBy(F.col("signal").desc()))
    leading = moving.where(F.col("date_idx") % hold == 0).withColumn("_first", first).where(F.col("_first") <= top_k)
    picked = average_rank(leading, "signal", "_place", DATE_KEYS, descending=True).where(F.col("_place") <= top_k)
    picked = per_group(picked, DATE_KEYS, {"_held": F.count(F.lit(1))}).select(*DATE_KEYS, "symbol", "date_idx", weight)

    keys = ["strategy", "symbol", "date_idx"]
    later = [F.struct((F.col("date_idx") + 1 + k).alias("_at"), F.lit(k > 0).alias("_last")) for k in (0, hold)]
    asked = picked.select(*keys, F.inline(F.array(*later))).distinct()
    prices = moving.where(F.col("date_idx") % hold == 1 % hold).select("strategy", "symbol", F.col("date_idx").alias("_at"), "open")
    # names that share a place up to top_k are under 2 * top_k, so the table grows with the calendar alone
    found = prices.join(F.broadcast(asked) if small else asked, ["strategy", "symbol", "_at"])
    ends = [F.first(F.when(F.col("_last") == last, F.col("open")), True).alias(name) for last, name in ((False, "_o1"), (True, "_o2"))]
    priced = picked.join(found.groupBy(*keys).agg(*ends), keys, "left")
    out = priced.withColumn("fwd", F.try_divide("_o2", "_o1") - 1).select(columns).unionByName(marks)
    if not flat:
        return out
    whole = rebalance_returns(rows.where(F.col("strategy").isin(list(flat))), hold)
    whole = per_group(whole, DATE_KEYS, {"_held": F.count(F.lit(1))})
    return out.unionByName(whole.withColumn("weight", weight).select(columns))


def panel_periods(
    signals: DataFrame, hold: int = 5, top_k: int = 20, filter_inactive: bool = True, stored: bool = False
) -> DataFrame:
    """Signals to (strategy, timestamp, period, gross, turnover).

    The signals are read for the calendar, the prices and the flatness test, so
    they are written out once, unless they are ``stored``: unpivoted from a written
    table. The result has one row per rebalance date and is read by every
    statistic, so it is written out too.
    """
    slim = signals.select("strategy", "timestamp", "symbol", "open", "signal")
    usable = usable_rows(slim if stored else written(slim, "signals"), filter_inactive)
    dates = date_indices(usable)
    rows = usable.join(dates, DATE_KEYS)
    held = rows.where(F.col("date_idx") % hold == 0)
    days = held.groupBy(*DATE_KEYS).agg((F.min("signal") < F.max("signal")).alias("moves"), F.count(F.lit(1)).alias("n"))
    # one row per strategy, a list the caller writes down
    each = days.groupBy("strategy").agg(F.max("moves").alias("moves"), F.max("n").alias("n"), F.count(F.lit(1)).alias("days")).collect()
    if any(r.n > row_limit(rows) for r in each):
        out = period_returns(target_weights(rebalance_returns(rows, hold), top_k), hold)
    else:
        flat = [r.strategy for r in each if not r.moves or r.strategy == EQUAL_WEIGHT]
        small = 4 * top_k * sum(r.days for r in each) <= SENT_ROWS
        with balanced(DATE_KEYS):
            out = period_returns(held_positions(rows, dates, flat, hold, top_k, small), hold)
    return written(out, "periods")


def net_returns(periods: DataFrame, cost_bps: float = ONE_WAY_BPS) -> DataFrame:
    return periods.withColumn("net", F.col("gross") - F.col("turnover") * (cost_bps / 10000.0))


def equity_curve(
    returns: DataFrame, value: str = "net", order: str = "timestamp", by: Sequence[str] = ("strategy",)
) -> DataFrame:
    """Cumulative equity, running peak and drawdown."""
    keys = list(by)
    df = running(returns, {"equity": 1.0 + F.col(value)}, keys, order, how="product")
    df = running(df, {"peak": F.col("equity")}, keys, order, how="max")
    drawdown = F.try_divide(F.col("equity") - F.col("peak"), F.col("peak"))
    return df.withColumn("drawdown", drawdown)


def _ratio(mean: Column, sd: Column, scale: float) -> Column:
    return F.when(sd > 0, F.try_divide(mean, sd) * scale).otherwise(0.0)


def performance(
    returns: DataFrame,
    value: str = "net",
    order: str = "timestamp",
    by: Sequence[str] = ("strategy",),
    hold: int = 5,
    risk_free: float = 0.0,
) -> DataFrame:
    """One row of return statistics per strategy."""
    keys = list(by)
    curve = equity_curve(returns, value, order, keys)
    r = F.col(value)
    excess = F.coalesce(finite(value), F.lit(0.0)) - risk_free / YEAR
    below = F.stddev_samp(F.when(excess < 0, excess))
    extra = [F.avg("turnover").alias("turnover")] if "turnover" in returns.columns else []
    return curve.groupBy(*keys).agg(
        F.count(r).alias("n_periods"),
        F.coalesce(_ratio(F.avg(r), F.stddev_samp(r), (YEAR / hold) ** 0.5), F.lit(0.0)).alias("sharpe"),
        F.coalesce(_ratio(F.avg(excess), below, (YEAR / 5) ** 0.5), F.lit(0.0)).alias("sortino"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        (F.max_by("equity", order) - 1.0).alias("cumulative_return"),
        F.avg(r).alias("mean_return"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_return"),
        F.coalesce(F.when(F.stddev_pop(r) > 0, F.skewness(r)), F.lit(0.0)).alias("skew"),
        F.coalesce(F.when(F.stddev_pop(r) > 0, F.kurtosis(r) + 3.0), F.lit(0.0)).alias("kurtosis"),
        *extra,
    )


def daily_sharpe(returns: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Annualised Sharpe of daily returns, missing values read as 0."""
    r = F.coalesce(finite(value), F.lit(0.0))
    near_zero = F.abs(F.stddev_samp(r)) <= 1e-8
    ratio = F.try_divide(F.avg(r), F.stddev_samp(r)) * YEAR**0.5
    return returns.groupBy(*by).agg(F.coalesce(F.when(~near_zero, ratio), F.lit(0.0)).alias("sharpe"))


def position_turnover(df: DataFrame, position: str, order: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute change of a position series; the first change is 0."""
    moved = over_series(
        df, lambda d, s: d.withColumn("_d", F.coalesce(F.abs(F.col(position) - s.lag(position)), F.lit(0.0))),
        keys=by, order=order, before=1,
    )
    return moved.groupBy(*by).agg(F.avg("_d").alias("turnover"))


# --- deflated Sharpe -----------------------------------------------------------------

EULER_GAMMA = 0.5772156649015329


def expected_best(trials: int | Column, variance: float = 0.04) -> Column:
    """Expected largest Sharpe among independent trials without skill; 0 for a single trial."""
    n = (F.lit(trials) if isinstance(trials, int) else trials).cast("double")
    many = F.when(n > 1, n)
    best = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / many) + EULER_GAMMA * normal_quantile(1 - 1 / (many * math.e))
    return F.coalesce(max(variance, 1e-6) ** 0.5 * best, F.lit(0.0))


def deflated_sharpe(
    stats: DataFrame, trials: Sequence[int] = TRIAL_COUNTS, variance: float = 0.04, hold: int = 5
) -> DataFrame:
    """Add ``dsr_<n>`` per trial count to a ``performance`` table (one row per strategy)."""
    scale = (YEAR / hold) ** 0.5
    n, sr = F.col("n_periods"), F.try_divide("mean_return", "std_return")
    spread = 1.0 - F.col("skew") * sr + (F.col("kurtosis") - 1.0) / 4.0 * sr * sr
    se = F.sqrt(F.greatest(spread / F.greatest(n - 1, F.lit(1)), F.lit(1e-8))) * scale
    known = (n >= 5) & (F.col("std_return") > 0)
    out = stats
    for count in trials:
        z = F.when(known, (sr * scale - expected_best(count, variance)) / (se + 1e-8))
        out = out.withColumn(f"dsr_{count}", F.coalesce(normal_cdf(z), F.lit(0.0)))
    return out


# --- whole backtests -----------------------------------------------------------------


def panel_backtest(
    signals: DataFrame,
    hold: int = 5,
    top_k: int = 20,
    cost_bps: float = ONE_WAY_BPS,
    filter_inactive: bool = True,
    trials: Sequence[int] = TRIAL_COUNTS,
    variance: float = 0.04,
    stored: bool = False,
) -> DataFrame:
    """One row of net performance per strategy, with deflated Sharpe ratios."""
    periods = panel_periods(signals, hold, top_k, filter_inactive, stored)
    return deflated_sharpe(performance(net_returns(periods, cost_bps), hold=hold), trials, variance, hold)


def cost_sweep(periods: DataFrame, levels: Sequence[float] = COST_LEVELS_BPS, hold: int = 5) -> DataFrame:
    """Net Sharpe per strategy and cost level; the periods are computed once."""
    costs = F.explode(F.array(*[F.lit(float(c)) for c in levels])).alias("cost_bps")
    rows = periods.select("strategy", "gross", "turnover", costs)
    net = F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10000.0
    sharpe = _ratio(F.avg(net), F.stddev_samp(net), (YEAR / hold) ** 0.5)
    return rows.groupBy("cost_bps", "strategy").agg(F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"))


def cost_table(sweep: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One row per cost level, one column per strategy."""
    return sweep.groupBy("cost_bps").pivot("strategy", list(strategies)).agg(F.first("sharpe"))


def align_returns(a: DataFrame, b: DataFrame, value: str = "net", least: int = 10) -> DataFrame:
    """(pos, a, b): returns of common dates, or by position when under ``least`` dates are common."""
    left = a.select("timestamp", F.col(value).alias("a")).dropna()
    right = b.select("timestamp", F.col(value).alias("b")).dropna()
    common = left.join(right, "timestamp")
    enough = common.agg(F.count(F.lit(1))).scalar() >= least

    def numbered(df: DataFrame) -> DataFrame:
        return running(df.withColumn("_all", F.lit(0)), {"pos": F.lit(1)}, ["_all"], "timestamp").drop("_all")

    by_place = numbered(left).drop("timestamp").join(numbered(right).drop("timestamp"), "pos")
    by_date = numbered(common).select("pos", "a", "b")
    return by_date.where(enough).unionByName(by_place.select("pos", "a", "b").where(~enough))


def compare_sharpe(net: DataFrame, pairs: Sequence[tuple[str, str]], draws: int = 1000) -> DataFrame:
    """Bootstrap Sharpe differences for pairs of strategies, all pairs in one job."""
    values = net.select("strategy", "timestamp", "net")
    listed = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a_name"), F.lit(b).alias("b_name")) for a, b in pairs])
    ).alias("pair")
    first = values.select("timestamp", F.col("net").alias("a"), "strategy", listed).where(
        F.col("strategy") == F.col("pair.a_name")
    )
    second = values.select(F.col("strategy").alias("b_name"), "timestamp", F.col("net").alias("b"))
    both = first.select("timestamp", "a", "pair.a_name", "pair.b_name").join(second, ["b_name", "timestamp"])
    return sharpe_difference(both, "a", "b", "timestamp", by=["a_name", "b_name"], draws=draws)


def scaled_backtest(
    df: DataFrame, signal: str, ret: str, order: str, cost_bps: float = ONE_WAY_BPS
) -> DataFrame:
    """Positions scaled by the signal's deviation, costs on position changes, in row order."""
    rows = df.select(order, F.col(signal).alias("signal"), F.col(ret).alias("ret")).dropna(subset=["signal", "ret"])
    spread = rows.agg(F.stddev_samp("signal")).scalar()
    rows = rows.withColumn("position", clip(F.col("signal") / (spread + 1e-6), -1, 1)).withColumn("all", F.lit(0))

    def build(d: DataFrame, s: Series) -> DataFrame:
        return d.withColumn("turnover", F.coalesce(F.abs(F.col("position") - s.lag("position")), F.lit(0.0)))

    rows = over_series(rows, build, keys=["all"], order=order, before=1)
    rows = rows.withColumn("net", F.col("position") * F.col("ret") - F.col("turnover") * (cost_bps / 10000.0))
    return performance(rows, "net", order, ["all"]).drop("all")


def clipped_backtest(df: DataFrame, pred: str, ret: str, order: str) -> DataFrame:
    """Clipped prediction times clipped return, accumulated in row order."""
    rows = df.select(order, F.col(pred).alias("p"), F.col(ret).alias("r")).dropna(subset=["p", "r"])
    rows = rows.withColumn("net", clip("p", -1, 1) * clip("r", -1, 1)).withColumn("all", F.lit(0))
    stats = performance(rows, "net", order, ["all"])
    sharpe = daily_sharpe(rows, "net", ["all"])
    return stats.drop("sharpe").join(sharpe, "all").select("sharpe", "cumulative_return", "mean_return", "max_drawdown")


def aligned_curves(net: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Equity per strategy in columns, on dates all strategies share, after a start row of 1."""
    curve = equity_curve(net).select("strategy", "timestamp", "equity")
    wide = curve.groupBy("timestamp").pivot("strategy", list(strategies)).agg(F.first("equity"))
    wide = wide.dropna(subset=list(strategies))
    start = wide.agg((F.min("timestamp") - F.expr("INTERVAL 5 DAYS")).alias("timestamp")).where(
        F.col("timestamp").isNotNull()
    )
    return start.select("timestamp", *[F.lit(1.0).alias(s) for s in strategies]).unionByName(wide)


def comparison_table(stats: DataFrame, strategies: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics in rows, strategies in columns."""
    typed = stats.select("strategy", *[F.col(m).cast("double").alias(m) for m in metrics])
    rows = typed.unpivot(["strategy"], list(metrics), "metric", "value")
    return rows.groupBy("metric").pivot("strategy", list(strategies)).agg(F.first("value"))


