"""Queries over linear walk-forward models and the frozen reference of a saved model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelark.functions.stats import newey_west
from panelark.operators import backtest, drift, folds, ic, linear, models, price
from panelark.operators.selection import without_sentiment
from panelark.plans.catalog_features import KEYS, LABEL, W, chg
from panelark.plans import catalog_inference as inference
from panelark.plans import research
from panelark.plans.catalog_inference import DATES, MEASURES, REPORT_SQL, ic_ctes, nw_ctes
from panelark.plans.catalog_portfolio import DSR_COLUMNS, RULES4, SIG_CTE, TOP_K, bt_ctes, dsr_sql
from panelark.plans.registry import TICKS_CTE, R, query, tidy
from panelark.session import cut_lineage, scratch_path, written
from panelark.sources.bundle import load_bundle, save_bundle

INPUTS = ["return_1d", "return_5d", "volume_change", "sentiment"]
PAIR = ["return_5d", "sentiment"]

# rows with their date number, and the folds' dates
ROWS = f"""{TICKS_CTE}, {DATES.format(src='ticks')},
  tf AS (SELECT symbol, "timestamp", coalesce({chg('close', 1)}, 0) AS return_1d, coalesce({chg('close', 5)}, 0) AS return_5d,
    coalesce({chg('volume', 1)}, 0) AS volume_change, sentiment, {LABEL} AS y FROM ticks WINDOW w AS ({W})),
  x AS (SELECT * FROM tf JOIN dates USING ("timestamp"))"""
FOLDS = """ck AS (SELECT "timestamp", date_idx, ntile(6) OVER (ORDER BY "timestamp") - 1 AS chunk FROM dates),
  fs AS (SELECT chunk AS fold, min(date_idx) AS first FROM ck WHERE chunk > 0 GROUP BY 1),
  plan AS (SELECT fold, 'train' AS role, "timestamp" FROM ck, fs WHERE date_idx < first - 6 AND chunk < fold
    UNION ALL SELECT chunk, 'test', "timestamp" FROM ck WHERE chunk > 0)"""
HOLDOUT = """hs AS (SELECT *, count(*) OVER () AS n FROM dates),
  plan AS (SELECT 1 AS fold, CASE WHEN date_idx >= greatest(2, floor(n * 0.8e0)) THEN 'test' ELSE 'train' END AS role, "timestamp" FROM hs)"""


def fit_sql(a: str, b: str, n: str = "") -> str:
    """Least squares on one or two inputs per fold, from regression aggregates or covariances; ``n`` ends the tables' names."""
    rows = f"""tr{n} AS (SELECT fold, {a} AS a, {b or '0'} AS b, y FROM plan JOIN x USING ("timestamp") WHERE role = 'train' AND y IS NOT NULL)"""
    if not b:
        return f"{rows}, model{n} AS (SELECT fold, regr_intercept(y, a) AS c, regr_slope(y, a) AS ka, 0 AS kb FROM tr{n} GROUP BY 1)"
    return f"""{rows}, cv{n} AS (SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb,
      covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM tr{n} GROUP BY 1),
    kv{n} AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ka, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS kb FROM cv{n}),
    model{n} AS (SELECT fold, my - ka * ma - kb * mb AS c, ka, kb FROM kv{n})"""


def test_sql(a: str, b: str, n: str = "") -> str:
    return f"""oof{n} AS (SELECT fold, symbol, "timestamp", c + ka * {a} + kb * {b or '0'} AS prediction, y FROM model{n}
      JOIN plan USING (fold) JOIN x USING ("timestamp") WHERE role = 'test')"""


def frame(t):
    steps = [price.add_returns, price.add_volume, price.add_label]
    return price.price_features(t.ticks, steps).select(*KEYS, *INPUTS, "future_return_5d")


SHOWN = f"""SELECT fold::INT AS fold, symbol, "timestamp", {R('prediction')}, {R('y', 'future_return_5d')} FROM oof"""


def shown(predictions):
    return tidy(predictions.drop("chosen"))


@query("walk_forward_linear", f"WITH {ROWS}, {FOLDS}, {fit_sql(*PAIR)}, {test_sql(*PAIR)} {SHOWN}")
def _(t):
    return shown(linear.walk_forward(frame(t), PAIR))


@query("walk_forward_slope", f"WITH {ROWS}, {FOLDS}, {fit_sql('return_5d', '')}, {test_sql('return_5d', '')} {SHOWN}")
def _(t):
    return shown(linear.walk_forward(frame(t), ["return_5d"]))


@query(
    "rolling_linear",
    f"""WITH {ROWS}, {FOLDS.replace('chunk < fold', 'chunk = fold - 1')}, {fit_sql(*PAIR)}, {test_sql(*PAIR)} {SHOWN}""",
)
def _(t):
    return shown(linear.walk_forward(frame(t), PAIR, expanding=False))


METRICS = f"""{R("sqrt(avg((y - prediction) ** 2))", "rmse")}, {R("1 - avg((y - prediction) ** 2) / var_pop(y)", "r2")},
  {R("avg((sign(prediction) = sign(y))::INT)", "hit_rate")}"""


@query(
    "linear_ablation",
    f"""WITH {ROWS}, {FOLDS}, {fit_sql(*PAIR)}, {test_sql(*PAIR)},
    {fit_sql('return_5d', '', '1')}, {test_sql('return_5d', '', '1')}
    SELECT 'with' AS inputs, count(*) AS n, {METRICS} FROM oof WHERE y IS NOT NULL
    UNION ALL SELECT 'without', count(*) AS n, {METRICS} FROM oof1 WHERE y IS NOT NULL""",
)
def _(t):
    """Walk-forward with and without the sentiment input."""
    df, out = frame(t).withColumnRenamed("sentiment", "sentiment_raw"), None
    names = ["return_5d", "sentiment_raw"]
    for label, chosen in (("with", names), ("without", without_sentiment(names))):
        part = models.pooled_metrics(linear.walk_forward(df, chosen)).withColumn("inputs", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


LONG = f"""long AS (SELECT "timestamp", feature, v AS x, y FROM (UNPIVOT (SELECT "timestamp", y, {', '.join(INPUTS)} FROM x)
  ON {', '.join(INPUTS)} INTO NAME feature VALUE v) WHERE y IS NOT NULL), {ic_ctes('long', 'feature, "timestamp"')}"""
CHOICE = f"""{LONG}, sc AS (SELECT fold, feature, avg(ic) AS score FROM ic JOIN plan USING ("timestamp") WHERE role = 'train' GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(score) DESC, feature) AS place,
    bool_or(abs(score) >= 0.01) OVER (PARTITION BY fold) AS enough FROM sc QUALIFY abs(score) >= 0.01 OR NOT enough),
  best AS (SELECT fold, feature FROM rk WHERE place = 1)"""
PICKED = f"CASE feature {' '.join(f'''WHEN '{f}' THEN {f}''' for f in INPUTS)} END"


@query(
    "nested_walk_forward_linear",
    f"""WITH {ROWS}, {FOLDS}, {CHOICE},
    tr AS (SELECT fold, feature, {PICKED} AS a, y FROM plan JOIN best USING (fold) JOIN x USING ("timestamp") WHERE role = 'train' AND y IS NOT NULL),
    model AS (SELECT fold, feature, regr_intercept(y, a) AS c, regr_slope(y, a) AS k FROM tr GROUP BY ALL),
    oof AS (SELECT fold, symbol, "timestamp", c + k * {PICKED} AS prediction, y, feature AS chosen FROM model JOIN plan USING (fold)
      JOIN x USING ("timestamp") WHERE role = 'test') {SHOWN.replace(' FROM oof', ', chosen FROM oof')}""",
)
def _(t):
    """The input of largest mean daily IC in each fold's training dates."""
    predictions = linear.nested_walk_forward(frame(t), INPUTS, top_k=1)
    return tidy(predictions.withColumn("chosen", F.col("chosen")[0]))


@query(
    "holdout_linear",
    f"""WITH {ROWS}, {HOLDOUT}, {fit_sql(*PAIR)}, {test_sql(*PAIR)}, d AS (SELECT "timestamp", prediction AS x, y FROM oof), {ic_ctes('d', '"timestamp"')}
    SELECT count(*) AS n, {METRICS}, (SELECT {R('avg(ic)', 'ic')} FROM ic) AS ic FROM oof WHERE y IS NOT NULL""",
)
def _(t):
    """Fitted once on the validation dates, judged once on the holdout dates."""
    df = frame(t)
    scored = linear.walk_forward(df, PAIR, linear.holdout_plan(folds.holdout_split(t.ticks)))
    mean_ic = ic.daily_rank_ic(scored, "prediction").agg(F.avg("ic").alias("ic")).scalar()
    return tidy(models.pooled_metrics(scored).withColumn("ic", mean_ic))


# --- comparison of strategies -------------------------------------------------------------

OHLCV_PAIR = ["return_5d", "volume_change"]
SIX = [*RULES4, "prediction_ohlcv", "prediction_full"]
COMPARED = research.COMPARED
COMPARED_SQL = f"""WITH {SIG_CTE}, {DATES.format(src='feat')}, {FOLDS}, x AS (SELECT *, future_return_5d AS y FROM feat),
  {fit_sql(*OHLCV_PAIR, 'o')}, {test_sql(*OHLCV_PAIR, 'o')}, {fit_sql(*PAIR, 'f')}, {test_sql(*PAIR, 'f')},
  six AS (SELECT * FROM sig UNION ALL SELECT 'prediction_ohlcv', "timestamp", symbol, open, future_return_5d, coalesce(prediction, 0) FROM feat
      LEFT JOIN oofo USING (symbol, "timestamp")
    UNION ALL SELECT 'prediction_full', "timestamp", symbol, open, future_return_5d, coalesce(prediction, 0) FROM feat LEFT JOIN ooff USING (symbol, "timestamp")),
  sd AS (SELECT strategy, "timestamp", signal AS x, future_return_5d AS y FROM six), {ic_ctes('sd', 'strategy, "timestamp"')}, {nw_ctes('ic', 'strategy', '"timestamp"')},
  {bt_ctes('six')}, ds AS ({DSR_COLUMNS}),
  mt AS (SELECT ds.strategy, nw.ic, t_stat, sharpe, {', '.join(f'{dsr_sql(n)} AS dsr_{n}' for n in (41, 100, 200))}, max_drawdown, turnover
    FROM ds LEFT JOIN nw ON nw.strategy = ds.strategy),
  u AS (FROM mt UNPIVOT INCLUDE NULLS (v FOR metric IN ({', '.join(COMPARED)})))
  SELECT metric, {', '.join(R(f"max(v) FILTER (WHERE strategy = '{s}')", s) for s in SIX)} FROM u GROUP BY 1"""


@query("six_strategies", COMPARED_SQL)
def _(t):
    """The research table: eight measures of four rules and two walk-forward models."""
    df = written(inference.features(t).select(*KEYS, "open", "return_5d", "momentum_12_1", "volume_change", "sentiment", "future_return_5d"), "bars")
    plan = cut_lineage(folds.fold_dates(df))
    predictions = {"prediction_ohlcv": linear.walk_forward(df, OHLCV_PAIR, plan), "prediction_full": linear.walk_forward(df, PAIR, plan)}
    columns, names = research.signal_columns(df, predictions)
    daily = written(ic.feature_rank_ic(columns, names).withColumnRenamed("feature", "strategy"), "daily-ic")
    errors = newey_west(daily, "ic", "timestamp", ["strategy"]).select("strategy", "ic", "t_stat")
    net = backtest.net_returns(backtest.panel_periods(backtest.long_signals(columns, names), top_k=TOP_K, filter_inactive=False, stored=True))
    table = backtest.deflated_sharpe(backtest.performance(net)).join(errors, "strategy", "left")
    return tidy(backtest.comparison_table(table, SIX, COMPARED))


# --- frozen reference ---------------------------------------------------------------------

WINDOW_DAYS = 10
FROZEN = f"""{ROWS}, last_ AS (SELECT max("timestamp") AS m FROM x),
  sides AS (SELECT true AS is_ref, * FROM x WHERE y IS NOT NULL UNION ALL
    SELECT false, * FROM x WHERE "timestamp" > (SELECT m FROM last_) - INTERVAL {WINDOW_DAYS} DAY),
  both_ AS (SELECT feature, is_ref, v AS x FROM (SELECT is_ref, {', '.join(INPUTS)} FROM sides)
    UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(INPUTS)}))), {MEASURES}"""


def _scored(t):
    """Train, save, load and score; the drift tables compare with the saved counts of all labelled rows."""
    steps = [price.add_returns, price.add_volume, price.add_label]
    df = cut_lineage(price.price_features(t.ticks, steps))
    folder = scratch_path(t.spark, "bundle")
    save_bundle(research.train_model(df, INPUTS), folder)
    return research.score_universe(df, load_bundle(t.spark, folder), days=WINDOW_DAYS)


@query("scored_drift", f"WITH {FROZEN} {REPORT_SQL}")
def _(t):
    return tidy(_scored(t)["drift"])


@query(
    "scored_drift_gate",
    f"""WITH {FROZEN}, g AS (SELECT (SELECT count(*) FROM sides WHERE NOT is_ref) AS current_rows, count(*) FILTER (WHERE psi > 0.25) AS breaches FROM psi)
    SELECT current_rows, breaches, CASE WHEN current_rows < 100 THEN 'SKIP' WHEN breaches >= 3 THEN 'HIGH' ELSE 'OK' END AS status FROM g""",
)
def _(t):
    return _scored(t)["gate"]


@query(
    "merged_value_counts",
    f"WITH {ROWS} SELECT feature, {R('v', 'x')}, count(*) AS n FROM (UNPIVOT (SELECT {', '.join(INPUTS)} FROM x) ON {', '.join(INPUTS)} INTO NAME feature VALUE v) GROUP BY 1, 2",
)
def _(t):
    """Counts of the days' rows, made apart and merged."""
    df = price.price_features(t.ticks, [price.add_returns, price.add_volume]).withColumns({c: F.round(F.col(c) + 1.7e-9, 6) + F.lit(0.0) for c in INPUTS})
    even = F.dayofmonth("timestamp") % 2 == 0
    return drift.merge_counts(drift.value_counts(df.where(even), INPUTS), drift.value_counts(df.where(~even), INPUTS))
