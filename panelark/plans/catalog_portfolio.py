"""Queries over costs, backtests, weights, position keeping and screening."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import functions as F

from panelark.functions import normal
from panelark.operators import backtest, costs, cross_asset, live, rows, screening, weights
from panelark.plans.catalog_features import KEYS, W
from panelark.plans.catalog_inference import FEAT_CTE, features, ic_ctes
from panelark.plans.registry import BARS_CTE, TICKS_CTE, R, RS, query, tidy
from panelark.session import cut_lineage, written

# prices of the test tables jump, so grown equity is compared on a log scale
def log_growth():
    return F.log1p("cumulative_return").alias("log_growth")


RULES4 = ["eq_weight_signal", "mom_12_1_signal", "reversal_5d_signal", "reversal_lowturnover_signal"]
TOP_K = 10

# --- costs ------------------------------------------------------------------------------


def _cost_sql(n: str, buy: str, sell: str, delivery: str) -> str:
    broke = f"(CASE WHEN {delivery} THEN 0 ELSE least(20, 0.0003e0 * {n}) END)"
    fees = f"(0.0000297e0 * {n} + 0.000001e0 * {n})"
    return f"""(CASE WHEN {n} <= 0 THEN 0 ELSE {broke} + CASE WHEN {delivery} THEN 0.001e0 * {n} WHEN {sell}
      THEN 0.00025e0 * {n} ELSE 0 END + {fees} + 0.18e0 * ({broke} + {fees}) + CASE WHEN {buy} THEN
      (CASE WHEN {delivery} THEN 0.00015e0 ELSE 0.00003e0 END) * {n} ELSE 0 END + 2.5e0 / 10000 * {n} END)"""


_ORDER_COST = _cost_sql("o_totalprice", "o_orderstatus <> 'F'", "o_orderstatus = 'F'", "o_orderpriority <> '1-URGENT'")


@query("trade_costs", f"SELECT o_orderkey, {R(_ORDER_COST, 'cost', 4)} FROM orders")
def _(t):
    side = F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "intraday").otherwise("delivery")
    cost = costs.trade_cost(F.col("o_totalprice"), side, kind)
    return tidy(t["orders"].select("o_orderkey", cost.alias("cost")), 4)


_BUY = _cost_sql("o_totalprice", "true", "false", "k = 'delivery'")
_SELL = _cost_sql("o_totalprice", "false", "true", "k = 'delivery'")


@query(
    "round_trip_costs",
    f"""WITH o AS (SELECT o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 'intraday' ELSE 'delivery' END AS k FROM orders),
    c AS (SELECT k AS trade_type, sum({_BUY} + {_SELL}) / sum(o_totalprice) * 10000 AS b FROM o GROUP BY 1)
    SELECT trade_type, {R('b', 'round_trip_bps')}, {R('b / 2', 'one_way_bps')} FROM c""",
)
def _(t):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "intraday").otherwise("delivery")
    trades = t["orders"].select(F.col("o_totalprice").alias("notional"), kind.alias("trade_type"))
    return tidy(costs.round_trip_bps(trades))


# --- backtest ---------------------------------------------------------------------------

SIG_CTE = f"""{FEAT_CTE}, sig AS (
  SELECT 'eq_weight_signal' AS strategy, "timestamp", symbol, open, future_return_5d, 1e0 AS signal FROM feat UNION ALL
  SELECT 'mom_12_1_signal', "timestamp", symbol, open, future_return_5d, momentum_12_1 FROM feat UNION ALL
  SELECT 'reversal_5d_signal', "timestamp", symbol, open, future_return_5d, -return_5d FROM feat UNION ALL
  SELECT 'reversal_lowturnover_signal', "timestamp", symbol, open, future_return_5d, -0.7e0 * return_5d + 0.3e0 * momentum_12_1
  FROM feat)"""


def bt_ctes(sig: str = "sig", top_k: int = TOP_K, hold: int = 5) -> str:
    return f"""bd AS (SELECT strategy, "timestamp", row_number() OVER (PARTITION BY strategy ORDER BY "timestamp") - 1 AS date_idx
     FROM (SELECT DISTINCT strategy, "timestamp" FROM {sig})),
  ix AS (SELECT s.*, date_idx FROM {sig} s JOIN bd USING (strategy, "timestamp")),
  fw AS (SELECT * EXCLUDE (o1, o2), o2 / nullif(o1, 0) - 1 AS fwd FROM (SELECT *,
     max(open) OVER (PARTITION BY strategy, symbol ORDER BY date_idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS o1,
     max(open) OVER (PARTITION BY strategy, symbol ORDER BY date_idx RANGE BETWEEN {1 + hold} FOLLOWING AND {1 + hold} FOLLOWING) AS o2 FROM ix)
     WHERE date_idx % {hold} = 0),
  rk AS (SELECT *, date_idx // {hold} AS period, rank() OVER (PARTITION BY strategy, "timestamp" ORDER BY signal DESC)
     + (count(*) OVER (PARTITION BY strategy, "timestamp", signal) - 1) / 2e0 AS place FROM fw),
  fl AS (SELECT strategy, strategy = 'eq_weight_signal' OR NOT bool_or(m) AS flat FROM (SELECT strategy, "timestamp",
     min(signal) < max(signal) AS m FROM fw GROUP BY 1, 2) GROUP BY 1),
  wt AS (SELECT strategy, "timestamp", period, symbol, fwd, CASE WHEN flat OR place <= {top_k} THEN 1e0
     / count(*) FILTER (WHERE flat OR place <= {top_k}) OVER (PARTITION BY strategy, "timestamp") ELSE 0e0 END AS weight
     FROM rk JOIN fl USING (strategy)),
  td AS (SELECT strategy, period, "timestamp", coalesce(sum(weight * fwd), 0) AS gross,
     sum(greatest(coalesce(weight, 0) * (1 + coalesce(fwd, 0)), 0)) AS total FROM wt GROUP BY 1, 2, 3),
  dw AS (SELECT strategy, period + 1 AS period, symbol, CASE WHEN total > 0 THEN greatest(weight * (1 + coalesce(fwd, 0)), 0) / total
     ELSE weight END AS old FROM wt JOIN td USING (strategy, period, "timestamp")),
  tn AS (SELECT strategy, period, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS turnover
     FROM (SELECT strategy, period, symbol, weight FROM wt) n FULL JOIN dw USING (strategy, period, symbol) GROUP BY 1, 2),
  pr AS (SELECT strategy, "timestamp", period, gross, turnover, gross - turnover * 13.61e0 / 10000 AS net
     FROM td JOIN tn USING (strategy, period)),
  eq AS (SELECT *, product(1 + net) OVER z AS equity FROM pr WINDOW z AS (PARTITION BY strategy ORDER BY "timestamp"
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  dd AS (SELECT *, max(equity) OVER z AS peak, avg(net) OVER (PARTITION BY strategy) AS m FROM eq
     WINDOW z AS (PARTITION BY strategy ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  st AS (SELECT strategy, count(*) AS n_periods, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(252e0 / {hold}) AS sharpe,
     coalesce(avg(net) / nullif(stddev_samp(net) FILTER (WHERE net < 0), 0), 0) * sqrt(252e0 / 5) AS sortino,
     min((equity - peak) / peak) AS max_drawdown, avg((net > 0)::INT) AS hit_rate, arg_max(equity, "timestamp") - 1 AS cumulative_return,
     avg(net) AS mean_return, stddev_samp(net) AS std_return, avg((net - m) ** 3) / var_pop(net) ** 1.5 AS skew,
     avg((net - m) ** 4) / var_pop(net) ** 2 AS kurtosis, avg(turnover) AS turnover FROM dd GROUP BY 1)"""


def signals(t):
    return backtest.rule_signals(features(t))


def stored_signals(t):
    """The signals from a written table of bars, a quarter of their rows."""
    names = ["timestamp", "symbol", "open", "return_5d", "momentum_12_1", "future_return_5d"]
    return backtest.rule_signals(written(features(t).select(*names), "bars"))


def periods(t):
    return backtest.panel_periods(stored_signals(t), top_k=TOP_K, filter_inactive=False, stored=True)


BT = f"WITH {SIG_CTE}, {bt_ctes()} "


@query("rule_signals", f"""WITH {SIG_CTE} SELECT strategy, "timestamp", symbol, {R('signal')} FROM sig""")
def _(t):
    return tidy(signals(t).select("strategy", *KEYS, "signal"))


@query("forward_returns", BT + f'SELECT strategy, "timestamp", symbol, {R("fwd")} FROM fw')
def _(t):
    df = backtest.rebalance_returns(backtest.with_date_index(stored_signals(t)))
    return tidy(df.select("strategy", *KEYS, "fwd"))


@query("target_weights", BT + f'SELECT strategy, "timestamp", symbol, {R("weight")} FROM wt')
def _(t):
    df = backtest.with_date_index(stored_signals(t)).where("date_idx % 5 = 0")
    return tidy(backtest.target_weights(df, TOP_K).select("strategy", *KEYS, "weight"))


@query("period_returns", BT + f'SELECT strategy, "timestamp", {RS("gross turnover net")} FROM pr')
def _(t):
    return tidy(backtest.net_returns(periods(t)).select("strategy", "timestamp", "gross", "turnover", "net"))


@query("equity_curve", BT + f'SELECT strategy, "timestamp", {R("ln(equity)", "log_equity")}, {R("ln(peak)", "log_peak")}, {R("(equity - peak) / peak", "drawdown")} FROM dd')
def _(t):
    curve = backtest.equity_curve(backtest.net_returns(periods(t)))
    logs = [F.ln("equity").alias("log_equity"), F.ln("peak").alias("log_peak")]
    return tidy(curve.select("strategy", "timestamp", *logs, "drawdown"))


METRICS = "sharpe sortino max_drawdown hit_rate mean_return std_return skew kurtosis turnover"


@query("strategy_performance", BT + f"SELECT strategy, n_periods, {R('ln(1 + cumulative_return)', 'log_growth')}, {RS(METRICS)} FROM st")
def _(t):
    return tidy(backtest.performance(backtest.net_returns(periods(t))).select("strategy", "n_periods", log_growth(), *METRICS.split()))


def cdf_sql(z: str) -> str:
    """The distribution function of ``functions.normal``, written for DuckDB."""
    x = f"abs({z})"
    top, bottom = (functools.reduce(lambda out, c: f"({out} * {x} + {c!r})", terms[1:], repr(terms[0])) for terms in (normal.TAIL_TOP, normal.TAIL_BOTTOM))
    far = functools.reduce(lambda out, k: f"({x} + {k} / {out})", (4, 3, 2, 1), f"({x} + 0.65e0)")
    tail = f"""CASE WHEN {x} > 37 THEN 0 WHEN {x} < {normal.TAIL_FROM!r} THEN exp(-{x} * {x} / 2) * {top} / {bottom}
      ELSE exp(-{x} * {x} / 2) / {far} / sqrt(2 * pi()) END"""
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def dsr_sql(trials: int) -> str:
    """Deflated Sharpe ratio from the columns of ``st``; the expected best trial is a number."""
    g, z = backtest.EULER_GAMMA, NormalDist().inv_cdf
    best = 0.2 * ((1 - g) * z(1 - 1 / trials) + g * z(1 - 1 / (trials * math.e)))
    return f"CASE WHEN n_periods >= 5 AND std_return > 0 THEN {cdf_sql(f'((sr * sqrt(252e0 / 5) - {best!r}) / (se + 1e-8))')} ELSE 0 END"


DSR_COLUMNS = """SELECT *, mean_return / nullif(std_return, 0) AS sr, sqrt(greatest((1 - skew * (mean_return / nullif(std_return, 0))
  + (kurtosis - 1) / 4 * (mean_return / nullif(std_return, 0)) ** 2) / greatest(n_periods - 1, 1), 1e-8)) * sqrt(252e0 / 5) AS se FROM st"""
DSR = f"""{BT}, ds AS ({DSR_COLUMNS})
  SELECT strategy, n_periods, {RS('sharpe sortino max_drawdown turnover')}, {R('ln(1 + cumulative_return)', 'log_growth')},
  {', '.join(R(dsr_sql(n), f'dsr_{n}') for n in backtest.TRIAL_COUNTS)} FROM ds"""


@query("deflated_sharpe", DSR)
def _(t):
    table = backtest.panel_backtest(stored_signals(t), top_k=TOP_K, filter_inactive=False, stored=True)
    shown = ["sharpe", "sortino", "max_drawdown", "turnover", *[f"dsr_{n}" for n in backtest.TRIAL_COUNTS]]
    return tidy(table.select("strategy", "n_periods", log_growth(), *shown))


PRED_CTE = f"""{FEAT_CTE}, sig AS (SELECT 'prediction_full' AS strategy, "timestamp", symbol, open, future_return_5d,
  CASE WHEN abs(return_5d) > 1.5e0 THEN return_5d ELSE 0 END AS signal FROM feat WHERE "timestamp" IN (SELECT "timestamp" FROM feat
  WHERE abs(return_5d) > 1.5e0))"""


@query(
    "backtest_active_dates",
    f"WITH {PRED_CTE}, {bt_ctes()} SELECT strategy, n_periods, {RS('sharpe max_drawdown turnover')}, {R('ln(1 + cumulative_return)', 'log_growth')} FROM st",
)
def _(t):
    signal = F.when(F.abs("return_5d") > 1.5, F.col("return_5d")).otherwise(0.0)
    df = features(t).withColumn("prediction_full", signal)
    net = backtest.net_returns(backtest.panel_periods(backtest.long_signals(df, ["prediction_full"]), top_k=TOP_K))
    stats = backtest.performance(net)
    return tidy(stats.select("strategy", "n_periods", "sharpe", "max_drawdown", "turnover", log_growth()))


COSTS = "[0, 5, 10, 13.61, 20, 25]"


@query(
    "cost_sensitivity",
    BT
    + f""", lv AS (SELECT unnest({COSTS})::DOUBLE AS cost_bps), ct AS (SELECT cost_bps, strategy,
    coalesce(avg(gross - turnover * cost_bps / 10000) / nullif(stddev_samp(gross - turnover * cost_bps / 10000), 0), 0) * sqrt(252e0 / 5) AS s
    FROM pr, lv GROUP BY 1, 2)
    SELECT round(cost_bps + 1.7e-9, 6) AS cost_bps, """
    + ", ".join(R(f"max(s) FILTER (WHERE strategy = '{s}')", s) for s in RULES4)
    + " FROM ct GROUP BY cost_bps",
)
def _(t):
    return tidy(backtest.cost_table(backtest.cost_sweep(periods(t)), RULES4))


ALIGN_SQL = BT + f"""SELECT "timestamp", {", ".join(R(f"ln(max(equity) FILTER (WHERE strategy = '{s}'))", s) for s in RULES4)}
  FROM dd GROUP BY 1 HAVING count(*) = 4 UNION ALL SELECT min("timestamp") - INTERVAL 5 DAY, 0, 0, 0, 0 FROM dd"""


@query("aligned_curves", ALIGN_SQL)
def _(t):
    curves = backtest.aligned_curves(backtest.net_returns(periods(t)), RULES4)
    return tidy(curves.select("timestamp", *[F.ln(s).alias(s) for s in RULES4]))


COMPARED = ["sharpe", "sortino", "max_drawdown", "turnover", "hit_rate", "cumulative_return", "mean_return", "std_return"]


@query(
    "strategy_comparison",
    BT + f""", u AS (UNPIVOT (SELECT strategy, {', '.join(COMPARED)} FROM st) ON {', '.join(COMPARED)} INTO NAME metric VALUE v)
    SELECT metric, {", ".join(R(f"max(v) FILTER (WHERE strategy = '{s}')", s) for s in RULES4)} FROM u GROUP BY 1""",
)
def _(t):
    stats = backtest.performance(backtest.net_returns(periods(t)))
    return tidy(backtest.comparison_table(stats, RULES4, COMPARED))


@query(
    "align_return_series",
    BT + f"""SELECT row_number() OVER (ORDER BY a."timestamp") AS pos, {R('a.net', 'a')}, {R('b.net', 'b')}
    FROM pr a JOIN pr b USING ("timestamp") WHERE a.strategy = 'reversal_5d_signal' AND b.strategy = 'eq_weight_signal'""",
)
def _(t):
    net = backtest.net_returns(periods(t))
    one = net.where("strategy = 'reversal_5d_signal'")
    other = net.where("strategy = 'eq_weight_signal'")
    return tidy(backtest.align_returns(one, other))


def _sr(x: str) -> str:
    return f"coalesce(avg({x}) / nullif(stddev_samp({x}), 0), 0) * sqrt(252e0 / 5)"


@query(
    "sharpe_difference",
    BT + f""", ps AS (SELECT a.net AS a, b.net AS b, row_number() OVER (ORDER BY a."timestamp") - 1 AS pos, count(*) OVER () AS size
      FROM pr a JOIN pr b USING ("timestamp") WHERE a.strategy = 'reversal_5d_signal' AND b.strategy = 'eq_weight_signal'),
    sh AS (SELECT DISTINCT size FROM ps),
    dr AS (SELECT size, b AS boot, k AS block, ('0x' || substr(md5('42|' || b || '|' || k), 1, 8))::BIGINT % size AS start
      FROM sh, range(1000) r(b), range((SELECT max(size) // 5 + 1 FROM sh)) q(k) WHERE k < ceil(size / 5e0)),
    ex AS (SELECT boot, (start + o) % size AS pos FROM dr, range(5) w(o) WHERE block * 5 + o < size),
    bs AS (SELECT boot, {_sr('a')} - {_sr('b')} AS d FROM ex JOIN ps USING (pos) GROUP BY 1),
    ob AS (SELECT {_sr('a')} - {_sr('b')} AS diff FROM ps)
    SELECT 'reversal_5d_signal' AS a_name, 'eq_weight_signal' AS b_name, {R('any_value(diff)', 'diff_sharpe')},
    {R("least(1, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)))", "p_value")},
    {R("quantile_cont(d, 0.025)", "ci_low")}, {R("quantile_cont(d, 0.975)", "ci_high")} FROM bs, ob""",
)
def _(t):
    net = backtest.net_returns(periods(t))
    return tidy(backtest.compare_sharpe(net, [("reversal_5d_signal", "eq_weight_signal")]))


FLAT_CTE = """f AS (SELECT event_id, value - 50e0 AS s, (user_id % 21 - 10) / 1000e0 AS r FROM events)"""


def _flat(t):
    return t["events"].select(
        "event_id", (F.col("value") - 50.0).alias("s"), ((F.col("user_id") % 21 - 10) / 1000.0).alias("r")
    )


@query(
    "scaled_backtest",
    f"""WITH {FLAT_CTE}, p AS (SELECT event_id, r, least(1, greatest(-1, s / ((SELECT stddev_samp(s) FROM f) + 1e-6))) AS p FROM f),
    n AS (SELECT event_id, coalesce(abs(p - lag(p) OVER (ORDER BY event_id)), 0) AS tn, p * r AS g FROM p),
    x AS (SELECT event_id, tn, g - tn * 13.61e0 / 10000 AS net FROM n),
    e AS (SELECT *, product(1 + net) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM x),
    d AS (SELECT *, max(q) OVER (ORDER BY event_id) AS pk FROM e)
    SELECT {R("avg(net) / stddev_samp(net) * sqrt(252e0 / 5)", "sharpe")}, {R("min(q / pk - 1)", "max_drawdown")},
    {R("avg(tn)", "turnover")}, {R("arg_max(q, event_id) - 1", "cumulative_return")}, {R("avg((net > 0)::INT)", "hit_rate")} FROM d""",
)
def _(t):
    stats = backtest.scaled_backtest(_flat(t), "s", "r", "event_id")
    return tidy(stats.select("sharpe", "max_drawdown", "turnover", "cumulative_return", "hit_rate"))


@query(
    "clipped_backtest",
    f"""WITH {FLAT_CTE}, x AS (SELECT event_id, least(1, greatest(-1, s / 100)) * least(1, greatest(-1, r)) AS net FROM f),
    e AS (SELECT *, product(1 + net) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM x),
    d AS (SELECT *, max(q) OVER (ORDER BY event_id) AS pk FROM e)
    SELECT {R("avg(net) / stddev_samp(net) * sqrt(252e0)", "sharpe")}, {R("arg_max(q, event_id) - 1", "cumulative_return")},
    {R("avg(net)", "mean_return")}, {R("min(q / pk - 1)", "max_drawdown")} FROM d""",
)
def _(t):
    df = _flat(t).withColumn("s", F.col("s") / 100)
    return tidy(backtest.clipped_backtest(df, "s", "r", "event_id"))


@query(
    "daily_sharpe",
    f"""WITH {TICKS_CTE} SELECT symbol, {R("coalesce(avg(sentiment) / nullif(stddev_samp(sentiment), 0) * sqrt(252e0), 0)", "sharpe")}
    FROM ticks GROUP BY 1""",
)
def _(t):
    return tidy(backtest.daily_sharpe(t.ticks, "sentiment", ["symbol"]))


@query(
    "position_turnover",
    f"""WITH {TICKS_CTE}, d AS (SELECT symbol, coalesce(abs(sentiment - lag(sentiment) OVER w), 0) AS d FROM ticks WINDOW w AS ({W}))
    SELECT symbol, {R("avg(d)", "turnover")} FROM d GROUP BY 1""",
)
def _(t):
    return tidy(backtest.position_turnover(t.ticks, "sentiment", "timestamp", ["symbol"]))


# --- weights ------------------------------------------------------------------------------


def pf_ctes(src: str, keys: str, held: str = "false", names: int = 10, cap: float = 0.05) -> str:
    return f"""pf1 AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY prediction DESC) AS place,
     count(*) OVER (PARTITION BY {keys}) AS n, {held} AS held FROM {src}),
   pf2 AS (SELECT *, CASE WHEN n >= 5 THEN least({names}, greatest(1, floor(n * 0.2e0))) ELSE least({names}, n) END AS k,
     CASE WHEN n >= 5 THEN floor(n * 0.3e0) ELSE 0 END AS b FROM pf1),
   pf3 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY symbol) AS rn FROM pf2
     WHERE place <= k OR (held AND place <= greatest(k, b))),
   pf4 AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS c FROM pf3 WHERE rn <= k),
   pf AS (SELECT s.*, CASE WHEN c IS NULL THEN 0 ELSE least({cap}e0, 1e0 / c) END AS weight FROM {src} s LEFT JOIN (SELECT {keys}, symbol, c FROM pf4)
     USING ({keys}, symbol))"""


SCORES = f"""{TICKS_CTE}, sc AS (SELECT symbol, "timestamp", close, volume, open, sentiment + volume / 100 AS prediction FROM ticks)"""


def scores(t):
    return t.ticks.withColumn("prediction", F.col("sentiment") + F.col("volume") / 100)


@query(
    "cash_weights",
    f"""WITH {SCORES}, {pf_ctes('sc', '"timestamp"', "right(symbol, 1) = '3'")} SELECT symbol, "timestamp", {R('weight')} FROM pf""",
)
def _(t):
    held = t["events"].select(
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("symbol")
    ).where(F.col("symbol").endswith("3"))
    return tidy(weights.cash_weights(scores(t), held=held).select(*KEYS, "weight"))


_shadow = f"""lt AS (SELECT * FROM feat WHERE "timestamp" = (SELECT max("timestamp") FROM feat)),
  sr AS (SELECT 'reversal_5d' AS strategy, symbol, "timestamp", -return_5d AS prediction FROM lt UNION ALL
    SELECT 'momentum_12_1', symbol, "timestamp", momentum_12_1 FROM lt),
  {pf_ctes('sr', 'strategy, "timestamp"')},
  eb AS (SELECT 'equal_weight' AS strategy, symbol, "timestamp", 1e0 AS prediction, CASE WHEN row_number() OVER (ORDER BY symbol)
    <= greatest(1, CASE WHEN count(*) OVER () >= 5 THEN floor(0.2e0 * count(*) OVER ()) ELSE count(*) OVER () END)
    THEN 1e0 / count(*) OVER () ELSE 0 END AS weight FROM lt)"""


@query(
    "shadow_targets",
    f"""WITH {FEAT_CTE}, {_shadow} SELECT strategy, symbol, "timestamp", {R('prediction')}, {R('weight')} FROM pf
    UNION ALL SELECT strategy, symbol, "timestamp", {R('prediction')}, {R('weight')} FROM eb""",
)
def _(t):
    latest = rows.latest_session(features(t))
    return tidy(weights.shadow_targets(latest).select("strategy", *KEYS, "prediction", "weight"))


# --- position keeping -----------------------------------------------------------------------

LIVE_CTE = f"""{SCORES}, last_ts AS (SELECT max("timestamp") AS m FROM ticks),
  sess AS (SELECT symbol, open, close, adv_20d FROM (SELECT *, avg(close * volume) OVER (PARTITION BY symbol ORDER BY "timestamp"
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv_20d FROM ticks), last_ts WHERE "timestamp" = m),
  acct AS (SELECT 'P' || (c_custkey % 4) AS portfolio, max(c_acctbal) * 100 AS cash FROM customer GROUP BY 1),
  pos AS (SELECT 'P' || (right(symbol, 2)::INT % 4) AS portfolio, symbol, floor(max(high)) AS qty, min(low) AS avg_price FROM ticks
    WHERE right(symbol, 1) IN ('1', '2', '5') GROUP BY 1, 2),
  tg0 AS (SELECT 'P' || (right(symbol, 2)::INT % 4) AS portfolio, symbol, prediction FROM sc, last_ts WHERE "timestamp" = m),
  {pf_ctes('tg0', 'portfolio', cap=0.3)},
  ev AS (SELECT portfolio, cash, cash + coalesce(sum(qty * close), 0) AS equity FROM acct LEFT JOIN pos USING (portfolio)
    LEFT JOIN sess USING (symbol) GROUP BY 1, 2),
  od0 AS (SELECT coalesce(p.portfolio, f.portfolio) AS portfolio, coalesce(p.symbol, f.symbol) AS symbol, coalesce(qty, 0) AS old_qty,
    coalesce(weight, 0) AS w FROM pos p FULL JOIN pf f ON p.portfolio = f.portfolio AND p.symbol = f.symbol),
  od1 AS (SELECT od0.*, open, adv_20d, CASE WHEN equity * w > 0 AND equity * w < 5000 THEN old_qty WHEN w > 0
    THEN floor(equity * w / open) ELSE 0 END AS target_qty FROM od0 JOIN sess USING (symbol) JOIN ev USING (portfolio) WHERE open > 0),
  od AS (SELECT *, target_qty - old_qty AS delta FROM od1 WHERE abs(target_qty - old_qty) >= 1),
  fl0 AS (SELECT *, abs(delta) * open AS notional FROM od),
  fl1 AS (SELECT *, open * (1 + CASE WHEN delta > 0 THEN 1 ELSE -1 END * (5 + 10 * sqrt(least(1, notional
    / greatest(coalesce(adv_20d, 1e7), 1e5)))) / 10000) AS fill_price,
    {_cost_sql('notional', 'delta > 0', 'delta < 0', 'true')} AS cost FROM fl0)"""


def _live(t):
    ticks = live.average_turnover(scores(t))
    session = rows.latest_session(ticks)
    book = F.concat(F.lit("P"), (F.substring("symbol", -2, 2).cast("int") % 4).cast("string"))
    account = F.concat(F.lit("P"), (F.col("c_custkey") % 4).cast("string"))
    accounts = t["customer"].groupBy(account.alias("portfolio")).agg((F.max("c_acctbal") * 100).alias("cash"))
    positions = (
        t.ticks.where(F.substring("symbol", -1, 1).isin("1", "2", "5"))
        .groupBy(book.alias("portfolio"), "symbol")
        .agg(F.floor(F.max("high")).cast("double").alias("qty"), F.min("low").alias("avg_price"))
    )
    targets = weights.cash_weights(
        session.select(book.alias("portfolio"), "symbol", "prediction"), ["portfolio"], max_weight=0.3
    )
    bars = session.select("symbol", "open", "close", "adv_20d")
    return accounts, positions, targets, bars


@query("mark_to_market", f"WITH {LIVE_CTE} SELECT portfolio, {R('cash', digits=2)}, {R('equity', digits=2)} FROM ev")
def _(t):
    accounts, positions, _targets, bars = _live(t)
    return tidy(live.mark_to_market(accounts, positions, bars), 2)


def _orders(t):
    accounts, positions, targets, bars = _live(t)
    equity = live.mark_to_market(accounts, positions, bars).select("portfolio", "equity")
    return accounts, positions, live.rebalance_orders(equity, positions, targets, bars)


@query("rebalance_orders", f"WITH {LIVE_CTE} SELECT portfolio, symbol, old_qty, target_qty, delta FROM od")
def _(t):
    return _orders(t)[2].select("portfolio", "symbol", "old_qty", "target_qty", "delta")


@query(
    "order_fills",
    f"WITH {LIVE_CTE} SELECT portfolio, symbol, delta, {R('notional', digits=4)}, {R('fill_price')}, {R('cost')} FROM fl1",
)
def _(t):
    fills = live.fill_orders(_orders(t)[2]).select("portfolio", "symbol", "delta", "notional", "fill_price", "cost")
    return tidy(fills, special={"notional": 4})


@query(
    "settlement",
    f"""WITH {LIVE_CTE}, s AS (SELECT portfolio, sum(delta * fill_price + cost) AS spent, sum(notional) AS tn, sum(cost) AS tc FROM fl1 GROUP BY 1)
    SELECT portfolio, {R("greatest(0, cash - coalesce(spent, 0))", "cash", 2)}, {R("coalesce(tn, 0)", "traded_notional", 2)},
    {R("coalesce(tc, 0)", "total_cost", 2)} FROM acct LEFT JOIN s USING (portfolio)""",
)
def _(t):
    accounts, _positions, orders = _orders(t)
    return tidy(live.settle(accounts, live.fill_orders(orders)), 2)


@query(
    "positions_after_fills",
    f"""WITH {LIVE_CTE} SELECT portfolio, symbol, qty, {R('avg_price')} FROM pos WHERE qty > 0 AND (portfolio, symbol) NOT IN
    (SELECT (portfolio, symbol) FROM fl1) UNION ALL SELECT portfolio, symbol, target_qty, {R('fill_price')} FROM fl1 WHERE target_qty > 0""",
)
def _(t):
    _accounts, positions, orders = _orders(t)
    return tidy(live.positions_after(positions, live.fill_orders(orders)))


@query(
    "average_daily_value",
    f"""WITH {TICKS_CTE} SELECT symbol, "timestamp", {R('''avg(close * volume) OVER (PARTITION BY symbol ORDER BY "timestamp"
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)''', 'adv_20d')} FROM ticks""",
)
def _(t):
    return tidy(live.average_turnover(t.ticks).select(*KEYS, "adv_20d"))


KS_CTES = """ks0 AS (SELECT strategy AS portfolio, "timestamp", equity, peak, equity / peak - 1 AS drawdown FROM dd),
  ks AS (SELECT *, bool_or(drawdown <= -0.1) OVER (PARTITION BY portfolio ORDER BY "timestamp") AS paused FROM ks0)"""


def history(t):
    curve = backtest.equity_curve(backtest.net_returns(periods(t)))
    return curve.select(F.col("strategy").alias("portfolio"), "timestamp", "equity")


@query("kill_switch", BT + f', {KS_CTES} SELECT portfolio, "timestamp", {R("ln(equity)", "log_equity")}, {R("ln(peak)", "log_peak")}, {R("drawdown")}, paused FROM ks')
def _(t):
    logs = [F.ln("equity").alias("log_equity"), F.ln("peak").alias("log_peak")]
    return tidy(live.kill_switch(history(t)).select("portfolio", "timestamp", *logs, "drawdown", "paused"))


@query(
    "history_upsert",
    """SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders GROUP BY 1, 2""",
)
def _(t):
    entries = t["orders"].select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return live.upsert_history(entries, ["o_custkey", "o_orderdate"], "o_orderkey")


LEVELS = range(11)  # of the tree in SQL: up to 1024 dates a log


def _tree_sql() -> str:
    """Leaves and levels of each log's tree, and the root over the first k leaves by the binary digits of k."""
    levels = [f"""t0 AS MATERIALIZED (SELECT portfolio, i - 1 AS idx, leaf AS h FROM lf)"""]
    for k in LEVELS[1:]:
        levels.append(f"""t{k} AS MATERIALIZED (SELECT portfolio, idx // 2 AS idx, CASE WHEN count(*) = 1 THEN min(h)
          ELSE sha256('1|' || max(h) FILTER (WHERE idx % 2 = 0) || '|' || max(h) FILTER (WHERE idx % 2 = 1)) END AS h FROM t{k - 1} GROUP BY 1, 2)""")
    root = "NULL"
    for k in LEVELS:
        root = f"CASE WHEN (i >> {k}) & 1 = 0 THEN {root} ELSE coalesce(sha256('1|' || p{k}.h || '|' || ({root})), p{k}.h) END"
    joins = " ".join(f"LEFT JOIN t{k} p{k} ON p{k}.portfolio = lf.portfolio AND p{k}.idx = (i >> {k}) - 1" for k in LEVELS)
    return f"{', '.join(levels)}, rt AS (SELECT lf.portfolio, signal_date, digest, leaf, i, {root} AS root FROM lf {joins})"


LOG_CTE = f"""{SCORES}, lg AS (SELECT 'P' || (right(symbol, 2)::INT % 4) AS portfolio, "timestamp" AS signal_date, symbol, prediction,
    volume / 100 AS weight FROM sc),
  lines AS (SELECT *, row_number() OVER (PARTITION BY portfolio, signal_date ORDER BY symbol) - 1 AS n,
    symbol || ':' || round(prediction, 8)::DECIMAL(28, 8)::VARCHAR || ':' || round(weight, 8)::DECIMAL(28, 8)::VARCHAR AS t FROM lg),
  lv1 AS (SELECT portfolio, signal_date, n // 1000 AS n, sha256(string_agg(t, ';' ORDER BY n)) AS d FROM lines GROUP BY 1, 2, n // 1000),
  lv2 AS (SELECT portfolio, signal_date, n // 1000 AS n, sha256(string_agg(d, ';' ORDER BY n)) AS d FROM lv1 GROUP BY 1, 2, n // 1000),
  dg AS (SELECT portfolio, signal_date, sha256(string_agg(d, ';' ORDER BY n)) AS digest FROM lv2 GROUP BY 1, 2),
  lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY signal_date) AS i,
    sha256('0|' || strftime(signal_date, '%Y-%m-%d %H:%M:%S') || '|' || digest) AS leaf FROM dg), {_tree_sql()}"""


def signal_log(t):
    book = F.concat(F.lit("P"), (F.substring("symbol", -2, 2).cast("int") % 4).cast("string"))
    return scores(t).select(
        book.alias("portfolio"),
        F.col("timestamp").alias("signal_date"),
        "symbol",
        "prediction",
        (F.col("volume") / 100).alias("weight"),
    )


@query(
    "signal_log_chain",
    f"""WITH {LOG_CTE} SELECT portfolio, signal_date, digest, leaf, coalesce(lag(root) OVER (PARTITION BY portfolio ORDER BY signal_date),
    repeat('0', 64)) AS previous_hash, root AS sha256 FROM rt""",
)
def _(t):
    return live.chain_log(cut_lineage(live.log_digests(signal_log(t))))


@query("signal_log_verification", f"WITH {LOG_CTE} SELECT portfolio, signal_date, true AS valid FROM rt")
def _(t):
    return live.verify_chain(live.chain_log(cut_lineage(live.log_digests(signal_log(t)))))


def _proof_sql() -> str:
    steps = [
        f"CASE WHEN s{k}.h IS NULL THEN NULL ELSE CASE WHEN ((i - 1) >> {k}) % 2 = 1 THEN 'L' ELSE 'R' END || s{k}.h END" for k in LEVELS
    ]
    joins = " ".join(f"LEFT JOIN t{k} s{k} ON s{k}.portfolio = rt.portfolio AND s{k}.idx = xor((i - 1) >> {k}, 1)" for k in LEVELS)
    return f"concat_ws(',', {', '.join(steps)}) AS proof, max_by(root, i) OVER (PARTITION BY rt.portfolio) AS root, true AS holds FROM rt {joins}"


@query("signal_log_proofs", f"WITH {LOG_CTE} SELECT rt.portfolio, signal_date, digest, {_proof_sql()}")
def _(t):
    """The nodes that prove each date, lowest first, with the side they stand on."""
    proofs = live.inclusion_proofs(cut_lineage(live.log_digests(signal_log(t))))
    side = F.transform("proof", lambda x: F.concat(F.when(x["left"], "L").otherwise("R"), x["hash"]))
    return proofs.select("portfolio", "signal_date", "digest", F.concat_ws(",", side).alias("proof"), "root", live.proof_holds().alias("holds"))


@query(
    "ledger_rows",
    f"""WITH {LIVE_CTE}, ps AS (SELECT * FROM pos WHERE portfolio <> 'P3' AND qty > 0) SELECT portfolio, coalesce(symbol, 'CASH') AS symbol,
    coalesce(qty, 0) AS quantity, {R('coalesce(avg_price, 1)', 'avg_price')}, {R('coalesce(qty * avg_price, cash)', 'notional', 4)},
    {R('cash', 'equity', 4)}, {R('cash', digits=4)}, {R('cash', 'peak_equity', 4)}, false AS paused FROM acct LEFT JOIN ps USING (portfolio)""",
)
def _(t):
    """Rows to JSON ledgers and back; one book is left empty."""
    accounts, positions, _targets, _bars = _live(t)
    full = accounts.withColumns({"last_equity": F.col("cash"), "peak_equity": F.col("cash"), "paused": F.lit(False)})
    documents = live.ledger_documents(full, positions.where("portfolio <> 'P3'"))
    special = {c: 4 for c in ("notional", "equity", "cash", "peak_equity")}
    return tidy(live.ledger_rows(documents), special=special)


@query(
    "performance_report",
    BT + f""", b AS (SELECT "timestamp", avg(close) AS c FROM feat GROUP BY 1), pi AS (SELECT "timestamp", -return_5d AS x,
      future_return_5d AS y FROM feat), {ic_ctes('pi', '"timestamp"')}, {KS_CTES}
    SELECT portfolio, (SELECT max("timestamp") FROM b) AS report_date, {R('ln(arg_max(equity, "timestamp"))', 'log_nav')},
    {R('ln(arg_max(equity, "timestamp") / arg_min(equity, "timestamp"))', 'log_growth')},
    {R('(SELECT arg_max(c, "timestamp") / arg_min(c, "timestamp") - 1 FROM b)', 'equal_weight_return')},
    {R('(SELECT arg_max(c, "timestamp") / arg_min(c, "timestamp") - 1 FROM b)', 'benchmark_return')},
    {R('(SELECT avg(ic) FROM ic)', 'live_rank_ic')}, {R('arg_max(drawdown, "timestamp")', 'portfolio_drawdown')} FROM ks GROUP BY 1""",
)
def _(t):
    df = features(t).withColumn("prediction", -F.col("return_5d"))
    bars = df.join(cross_asset.market_mean(df), "timestamp")
    report = live.performance_report(bars, live.kill_switch(history(t)))
    logs = {"log_nav": F.ln("strategy_nav"), "log_growth": F.log1p("strategy_return")}
    return tidy(report.withColumns(logs).drop("strategy_nav", "strategy_return"))


# --- screening --------------------------------------------------------------------------------

_LEADS = f"""ld0 AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pv,
   lag(close) OVER w AS pc, row_number() OVER w AS k, lead(close) OVER w AS nx FROM bars WINDOW w AS ({W})),
  ld1 AS (SELECT *, volume / CASE WHEN pv > 0 THEN pv ELSE 1 END AS vr, CASE WHEN pc > 0 THEN close / pc - 1 ELSE 0 END AS mv FROM ld0
   WHERE nx IS NULL AND k >= 10),
  ld AS (SELECT * FROM ld1 WHERE vr >= 1.3 OR abs(mv) >= 0.015)"""
LEAD_CTE = f"{BARS_CTE}, {_LEADS}"


@query(
    "lead_screen",
    f"""WITH {LEAD_CTE} SELECT symbol, "timestamp", {RS('close volume')}, {R('round(vr, 2)', 'vol_ratio')},
    {R('round(mv * 100, 2)', 'price_move_pct')} FROM ld""",
)
def _(t):
    leads = screening.find_leads(t.bars)
    return tidy(leads.select(*KEYS, "close", "volume", "vol_ratio", "price_move_pct"))


LEVEL_CTE = f"""{BARS_CTE}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
   lead(close) OVER w AS nx FROM bars WINDOW w AS ({W})),
  lv0 AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr,
   max(high) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS h52,
   min(low) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l52,
   avg(close) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS sma FROM tr),
  lv AS (SELECT symbol, "timestamp", close AS price, close AS entry, greatest(1, close - greatest(atr * 1.5, close * 0.015)) AS stop,
   close + 2 * greatest(atr * 1.5, close * 0.015) AS target, atr, h52, l52, sma, coalesce(close / nullif(h52, 0) * 100 - 100, 0) AS dist,
   date_diff('day', "timestamp"::DATE, DATE '2001-11-05')::INT AS age FROM lv0 WHERE nx IS NULL)"""


@query(
    "price_levels",
    f"""WITH {LEVEL_CTE} SELECT symbol, {R('round(price, 2)', 'price')}, {R('round(entry, 2)', 'entry')}, {R('round(stop, 2)', 'stop')},
    {R('round(target, 2)', 'target')}, {R('round(atr, 2)', 'atr_14')}, {R('round(h52, 2)', 'high_52w')}, {R('round(l52, 2)', 'low_52w')},
    {R('round(sma, 2)', 'sma_200')}, {R('round(dist, 2)', 'dist_from_52w_high_pct')}, age AS data_age_days, "timestamp"::DATE AS last_date FROM lv""",
)
def _(t):
    return tidy(screening.price_levels(t.bars, F.lit("2001-11-05").cast("date")))


GATE_CTE = f"""{LEVEL_CTE}, gt AS (SELECT symbol, round(price, 2) AS price, round(entry, 2) AS entry, round(stop, 2) AS stop, age,
    CASE WHEN round(price, 2) < 1500 THEN 'REJECT' WHEN age > 3 THEN 'REJECT' WHEN right(symbol, 1) = '7' THEN 'REJECT'
    WHEN greatest(0, (round(entry, 2) - round(stop, 2)) / nullif(round(entry, 2), 0) * 100) * 0.05 > 1 THEN 'REDUCE' ELSE 'APPROVE' END AS verdict,
    CASE WHEN round(price, 2) < 1500 THEN 'price below minimum' WHEN age > 3 THEN 'stale data' WHEN right(symbol, 1) = '7' THEN 'feature drift'
    WHEN greatest(0, (round(entry, 2) - round(stop, 2)) / nullif(round(entry, 2), 0) * 100) * 0.05 > 1 THEN 'stop too wide'
    ELSE 'passes all gates' END AS reason FROM lv)"""
DESK_RULES = {"min_price": 1500.0, "max_data_age_days": 3, "max_cards_per_day": 5}


def gated(t):
    levels = screening.price_levels(t.bars, F.lit("2001-11-05").cast("date"))
    return screening.risk_gate(levels.withColumn("high_drift", F.col("symbol").endswith("7")), DESK_RULES)


@query("risk_gate", f"WITH {GATE_CTE} SELECT symbol, verdict, reason FROM gt")
def _(t):
    return gated(t).select("symbol", "verdict", "reason")


@query(
    "sized_decisions",
    f"""WITH {GATE_CTE}, {_LEADS} SELECT symbol, {R('round(vr, 2)', 'vol_ratio')}, verdict, {R('entry')},
    floor(1000000 * CASE WHEN verdict = 'REDUCE' THEN 2.5e0 ELSE 5e0 END / 100 / entry)::BIGINT AS qty
    FROM ld JOIN gt USING (symbol) WHERE verdict <> 'REJECT' ORDER BY round(vr, 2) DESC, symbol LIMIT 5""",
)
def _(t):
    decided = screening.sized_decisions(screening.find_leads(t.bars), gated(t), rules=DESK_RULES)
    return tidy(decided.select("symbol", "vol_ratio", "verdict", "entry", "qty"))
