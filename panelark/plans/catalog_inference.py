"""Queries over ranks, information coefficients, folds, quality and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelark.functions.calendar import calendar
from panelark.functions.ranks import average_rank
from panelark.functions.stats import bootstrap_mean_ci, newey_west
from panelark.operators import drift, folds, ic, neighbours, price, quality, rows, selection
from panelark.plans.catalog_features import KEYS, LABEL, RET1, TAIL, W, chg, steps
from panelark.plans.registry import BARS_CTE, TICKS_CTE, R, RS, query, tidy
from panelark.session import cut_lineage, written
from panelark.sources import spec

FEATURES = ["return_1d", "return_5d", "return_20d", "volume_change", "momentum_12_1", "sentiment"]
FEAT_CTE = f"""{BARS_CTE}, feat AS MATERIALIZED (SELECT symbol, "timestamp", open, close, volume, {RET1} AS return_1d,
   coalesce({chg('close', 5)}, 0) AS return_5d, coalesce({chg('close', 20)}, 0) AS return_20d,
   coalesce({chg('volume', 1)}, 0) AS volume_change,
   coalesce(lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1, 0) AS momentum_12_1, sentiment,
   {LABEL} AS future_return_5d {TAIL})"""
LONG_CTE = f"""{FEAT_CTE}, long AS (SELECT "timestamp", feature, x, future_return_5d AS y FROM
   (UNPIVOT feat ON {', '.join(FEATURES)} INTO NAME feature VALUE x) WHERE future_return_5d IS NOT NULL)"""


def features(t):
    wide = steps(t, price.add_returns, price.add_momentum, price.add_volume, price.add_label)
    return wide.select(*KEYS, "open", "close", "volume", *FEATURES, "future_return_5d")


def long(t):
    return ic.long_features(features(t), FEATURES)


def daily(t):
    # one row per feature and date, read several times
    return written(ic.feature_rank_ic(features(t), FEATURES), "daily-ic")


def ic_ctes(src: str, keys: str, name: str = "ic") -> str:
    return f"""{name}_rk AS (SELECT {keys}, x, y,
     rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2e0 AS rx,
     rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2e0 AS ry
     FROM {src} WHERE x IS NOT NULL AND y IS NOT NULL),
   {name}_all AS (SELECT {keys}, count(*) AS n,
     CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(rx, ry), 12) END AS ic FROM {name}_rk GROUP BY {keys}),
   {name} AS (SELECT {keys}, ic FROM {name}_all WHERE n >= 3 AND ic IS NOT NULL)"""


REV_CTE = f"""{FEAT_CTE}, rev AS (SELECT symbol, "timestamp", -return_5d AS x, future_return_5d AS y FROM feat)"""


def reversal(t):
    df = steps(t, price.add_returns, price.add_label)
    return df.select(*KEYS, (-F.col("return_5d")).alias("signal"), "future_return_5d")


@query("daily_rank_ic", f"""WITH {REV_CTE}, {ic_ctes('rev', '"timestamp"')} SELECT "timestamp", {R("ic")} FROM ic""")
def _(t):
    return tidy(ic.feature_rank_ic(reversal(t), ["signal"]).drop("feature"))


@query(
    "average_rank",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp", rank() OVER (PARTITION BY "timestamp" ORDER BY sentiment)
    + (count(*) OVER (PARTITION BY "timestamp", sentiment) - 1) / 2e0 AS low_first,
    rank() OVER (PARTITION BY "timestamp" ORDER BY return_5d DESC)
    + (count(*) OVER (PARTITION BY "timestamp", return_5d) - 1) / 2e0 AS high_first FROM feat""",
)
def _(t):
    df = average_rank(features(t), "sentiment", "low_first", ["timestamp"])
    return average_rank(df, "return_5d", "high_first", ["timestamp"], descending=True).select(
        *KEYS, "low_first", "high_first"
    )


FIC = ic_ctes("long", 'feature, "timestamp"')
STATS_SQL = """SELECT feature, avg(ic) AS mean_ic, median(ic) AS median_ic, coalesce(stddev_samp(ic), 1e-4) AS ic_std,
   avg(ic) / (coalesce(stddev_samp(ic), 1e-4) + 1e-6) AS icir, avg((ic > 0)::INT) AS pct_positive_ic
   FROM ic GROUP BY 1"""


@query(
    "ic_statistics",
    f"WITH {LONG_CTE}, {FIC}, s AS ({STATS_SQL}) SELECT feature, {RS('mean_ic median_ic ic_std icir pct_positive_ic')} FROM s",
)
def _(t):
    return tidy(ic.ic_statistics(daily(t)))


@query(
    "pooled_rank_ic",
    f"""WITH {REV_CTE}, one AS (SELECT 0 AS g, x, y FROM rev), {ic_ctes('one', 'g')}
    SELECT n, {R("coalesce(ic, 0)", "ic")} FROM ic_all""",
)
def _(t):
    # ranked range by range: read for the ranges, their sizes and the ranks, of either side
    return tidy(ic.pooled_rank_ic(written(reversal(t).select("signal", "future_return_5d"), "reversal"), "signal", "future_return_5d"))


@query(
    "pearson_ic",
    f"""WITH {FEAT_CTE}, u AS (UNPIVOT feat ON {', '.join(FEATURES)} INTO NAME feature VALUE x)
    SELECT feature, {R("corr(x, coalesce(future_return_5d, 0))", "ic")} FROM u GROUP BY 1""",
)
def _(t):
    wide = features(t).select("future_return_5d", *FEATURES)
    rows_long = wide.unpivot(["future_return_5d"], FEATURES, "feature", "x")
    return tidy(ic.pearson_ic(rows_long, "x", "future_return_5d", ["feature"]))


def nw_ctes(src: str, key: str, order: str) -> str:
    lag = ", ".join(f"lag(e, {k}) OVER z AS e{k}" for k in range(1, 6))
    terms = " + ".join(f"2 * (1 - {k}e0 / 6) * coalesce(avg(e * e{k}), 0)" for k in range(1, 6))
    return f"""er AS (SELECT {key}, {order}, ic, ic - avg(ic) OVER (PARTITION BY {key}) AS e FROM {src}),
    lg AS (SELECT *, {lag} FROM er WINDOW z AS (PARTITION BY {key} ORDER BY {order})),
    nv AS (SELECT {key}, count(*) AS n, avg(ic) AS ic, CASE WHEN min(ic) = max(ic) THEN 0e0 ELSE
      sqrt(greatest(avg(e * e) + {terms}, 1e-8) / count(*)) END AS nw_se FROM lg GROUP BY {key}),
    nw AS (SELECT *, coalesce(ic / nullif(nw_se, 0), 0) AS t_stat FROM nv)"""


@query(
    "newey_west",
    f"""WITH {LONG_CTE}, {FIC}, {nw_ctes('ic', 'feature', '"timestamp"')}
    SELECT feature, n, {RS('ic nw_se t_stat')} FROM nw""",
)
def _(t):
    return tidy(newey_west(daily(t), "ic", "timestamp", ["feature"]))


@query(
    "product_inference",
    f"""WITH m AS (SELECT avg(value) AS mp, avg(user_id) AS ma, stddev_pop(value) * stddev_pop(user_id) AS sd FROM events),
    pr AS (SELECT 0 AS g, event_id, (value - mp) * (user_id - ma) / (sd + 1e-8) AS ic FROM events, m),
    {nw_ctes('pr', 'g', 'event_id')} SELECT n, {RS('ic nw_se t_stat')} FROM nw""",
)
def _(t):
    series = ic.product_series(t["events"], "value", "user_id", "event_id")
    return tidy(newey_west(series, "ic", "event_id"))


def boot_ctes(src: str, key: str, order: str, draws: int, sums: str) -> str:
    """Replicates by expanding every drawn row, an independent form of the block sums."""
    return f"""ps AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos,
      count(*) OVER (PARTITION BY {key}) AS size FROM {src}),
    sh AS (SELECT DISTINCT {key}, size FROM ps),
    dr AS (SELECT {key}, size, b AS boot, k AS block,
      ('0x' || substr(md5('42|' || b || '|' || k), 1, 8))::BIGINT % size AS start
      FROM sh, range({draws}) r(b), range(10000000) q(k) WHERE k < ceil(size / 5e0)),
    ex AS (SELECT dr.{key}, dr.size, boot, (start + o) % dr.size AS pos FROM dr, range(5) w(o) WHERE block * 5 + o < dr.size),
    bs AS (SELECT ex.{key}, boot, {sums} FROM ex JOIN ps USING ({key}, pos) GROUP BY 1, 2)"""


BOOT_SHAPE = boot_ctes("ic2", "feature", '"timestamp"', 500, "avg(ic) AS m").replace(
    "range(10000000) q(k)", "range((SELECT max(size) // 5 + 1 FROM sh)) q(k)"
)


@query(
    "block_bootstrap_ci",
    f"""WITH {LONG_CTE}, {FIC}, ic2 AS (SELECT * FROM ic), {BOOT_SHAPE}
    SELECT feature, {R("quantile_cont(m, 0.025)", "ci_low")}, {R("quantile_cont(m, 0.975)", "ci_high")} FROM bs GROUP BY 1""",
)
def _(t):
    return tidy(bootstrap_mean_ci(daily(t), "ic", "timestamp", ["feature"]))


@query(
    "ic_by_year",
    f"""WITH {LONG_CTE}, {FIC} SELECT feature, year("timestamp")::INT AS "year", {R("avg(ic)", "ic")} FROM ic GROUP BY 1, 2""",
)
def _(t):
    return tidy(ic.ic_by_year(daily(t), ["feature"]))


DATES = 'dates AS (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS date_idx FROM (SELECT DISTINCT "timestamp" FROM {src}))'
STAB_CTES = f"""{DATES.format(src='feat')}, ck AS (SELECT "timestamp", ntile(4) OVER (ORDER BY "timestamp") - 1 AS chunk FROM dates),
  lc AS (SELECT feature, chunk, x, y FROM long JOIN ck USING ("timestamp")), {ic_ctes('lc', 'feature, chunk', 'ch')},
  st AS (SELECT feature, avg(abs(coalesce(ic, 0))) AS size, stddev_pop(coalesce(ic, 0)) AS sd FROM ch_all WHERE n > 5 GROUP BY 1),
  stab AS (SELECT feature, CASE WHEN size = 0 THEN 0 ELSE least(1, greatest(0, 1 - sd / (size + 1e-6))) END AS stability FROM st)"""


@query("stability", f"WITH {LONG_CTE}, {STAB_CTES} SELECT feature, {R('stability')} FROM stab")
def _(t):
    df = written(features(t).select("timestamp", *FEATURES, "future_return_5d"), "features")
    return tidy(ic.stability(ic.long_features(df, FEATURES), calendar(df)))


_CUTS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
MI_CTES = f"""eg AS (SELECT feature, quantile_disc(x, {_CUTS}) AS ex, quantile_disc(y, {_CUTS}) AS ey FROM long GROUP BY 1),
  bn AS (SELECT feature, len(list_filter(ex, lambda e: e < x)) AS bx, len(list_filter(ey, lambda e: e < y)) AS by_
    FROM long JOIN eg USING (feature)),
  ce AS (SELECT feature, bx, by_, count(*)::DOUBLE AS n FROM bn GROUP BY 1, 2, 3),
  cm AS (SELECT *, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, by_) AS ny,
    sum(n) OVER (PARTITION BY feature) AS al FROM ce),
  mi AS (SELECT feature, greatest(sum(n / al * ln(n * al / (nx * ny))), 0) AS mutual_info FROM cm GROUP BY 1)"""


@query("mutual_information", f"WITH {LONG_CTE}, {MI_CTES} SELECT feature, {R('mutual_info')} FROM mi")
def _(t):
    df = written(features(t).select("timestamp", *FEATURES, "future_return_5d"), "features")
    return tidy(selection.feature_information(df, FEATURES))


def _psi(n: str) -> str:
    """SQL of ``neighbours.digamma``."""
    z = f"(({n}) + 6e0)"
    series = f"(1e0/12 - (1e0/120 - (1e0/252 - 1e0/240 / ({z}*{z})) / ({z}*{z})) / ({z}*{z})) / ({z}*{z})"
    return f"(ln({z}) - 0.5e0 / {z} - {series} - {' - '.join(f'1e0 / (({n}) + {i}e0)' for i in range(6))})"


NEAREST_CTES = f"""dm AS (SELECT feature, "timestamp", avg(x) AS x, avg(y) AS y FROM long GROUP BY 1, 2),
  sd AS (SELECT feature, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM dm GROUP BY 1),
  pt AS MATERIALIZED (SELECT feature, row_number() OVER () AS i, coalesce(round(x / nullif(sx, 0) * 1e9), 0)::BIGINT AS px,
    coalesce(round(y / nullif(sy, 0) * 1e9), 0)::BIGINT AS py FROM dm JOIN sd USING (feature)),
  kn AS MATERIALIZED (SELECT a.feature, a.i, min(greatest(abs(a.px - b.px), abs(a.py - b.py)), 3)[3] AS r
    FROM pt a JOIN pt b ON a.feature = b.feature AND a.i <> b.i GROUP BY 1, 2),
  cn AS (SELECT a.feature, a.i, any_value(r) AS r, count(*) FILTER (abs(a.px - b.px) < r OR (r = 0 AND a.px = b.px))::DOUBLE AS nx,
    count(*) FILTER (abs(a.py - b.py) < r OR (r = 0 AND a.py = b.py))::DOUBLE AS ny,
    count(*) FILTER (a.px = b.px AND a.py = b.py)::DOUBLE AS nw
    FROM pt a JOIN kn USING (feature, i) JOIN pt b ON a.feature = b.feature GROUP BY 1, 2),
  nm AS (SELECT feature, greatest({_psi('count(*)')} + avg({_psi('CASE WHEN r > 0 THEN 3e0 ELSE nw END')} - {_psi('nx')} - {_psi('ny')}), 0)
    AS mutual_info FROM cn GROUP BY 1)"""


@query("nearest_mutual_information")
def _(t):
    # read for the spreads and the points
    df = written(features(t).select("timestamp", *FEATURES, "future_return_5d"), "features")
    return tidy(neighbours.nearest_mutual_information(ic.long_features(df, FEATURES)))


@query("daily_mutual_information", f"WITH {LONG_CTE}, {NEAREST_CTES} SELECT feature, {R('mutual_info')} FROM nm")
def _(t):
    """How much the cross-section mean of a feature says about the mean label of its date."""
    means = long(t).groupBy("feature", "timestamp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return tidy(neighbours.nearest_mutual_information(means))


SCORE_CTES = f"""{LONG_CTE}, {FIC}, s AS ({STATS_SQL}), {STAB_CTES}, {MI_CTES},
  sc AS (SELECT s.*, stability, mutual_info, 0.35e0 * abs(mean_ic) + 0.25e0 * least(abs(icir), 3) / 3 + 0.2e0 * stability
    + 0.2e0 * least(mutual_info * 10, 1) AS score FROM s JOIN stab USING (feature) JOIN mi USING (feature))"""


def scored(t):
    # read for the daily coefficients, the calendar, the chunks and the bins
    df = written(features(t).select("timestamp", *FEATURES, "future_return_5d"), "features")
    rows_long = ic.long_features(df, FEATURES)
    table = ic.ic_statistics(ic.feature_rank_ic(df, FEATURES))
    mi = selection.feature_information(df, FEATURES)
    # the information table also serves as the importance input here
    table = table.join(ic.stability(rows_long, calendar(df)), "feature").join(mi, "feature")
    return cut_lineage(selection.composite_score(table.withColumn("model_importance", F.col("mutual_info"))))


@query("composite_score", f"WITH {SCORE_CTES} SELECT feature, {RS('mean_ic icir stability mutual_info score')} FROM sc")
def _(t):
    return tidy(scored(t).select("feature", "mean_ic", "icir", "stability", "mutual_info", "score"))


@query(
    "feature_shortlist",
    f"""WITH {SCORE_CTES}, pass AS (SELECT feature FROM sc WHERE abs(mean_ic) >= 0.02)
    SELECT feature, {R('score')} FROM sc WHERE feature IN (SELECT feature FROM pass) OR
    (NOT EXISTS (SELECT * FROM pass) AND feature IN (SELECT feature FROM sc ORDER BY score DESC, feature LIMIT 3))""",
)
def _(t):
    return tidy(selection.shortlist(scored(t), min_ic=0.02, fallback=3).select("feature", "score"))


_pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(
    "correlation_matrix",
    f"WITH {FEAT_CTE} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'corr')} FROM feat" for a, b in _pairs),
)
def _(t):
    return tidy(selection.correlation_pairs(features(t), FEATURES))


@query(
    "feature_spec_join",
    f"""WITH {LONG_CTE}, {FIC}, s AS ({STATS_SQL}), spec(feature, category, lag) AS (VALUES ('return_1d', 'returns', 1),
    ('return_5d', 'returns', 5), ('return_20d', 'returns', 20), ('volume_change', 'volume', 1))
    SELECT feature, category, lag::INT AS lag, {R('mean_ic')} FROM s JOIN spec USING (feature)""",
)
def _(t):
    """Declared features that are present, with their category, lag and measured IC."""
    specs = spec.spec_table(t.spark, spec.declared_specs()).withColumnRenamed("name", "feature")
    stats = ic.ic_statistics(daily(t))
    return tidy(stats.join(specs, "feature").select("feature", "category", "lag", "mean_ic"))


# --- quality ----------------------------------------------------------------------

_QCOLS = ["return_1d", "alias_1d", "mostly_null", "constant", "tiny", "sentiment", "volume"]


def _quality_frame(t):
    return features(t).select(
        *KEYS,
        "return_1d",
        F.col("return_1d").alias("alias_1d"),
        F.when(F.col("volume") > 40, F.col("close")).alias("mostly_null"),
        F.lit(3.0).alias("constant"),
        (F.col("sentiment") / 1e6).alias("tiny"),
        "sentiment",
        "volume",
    )


@query(
    "quality_gate",
    f"""WITH {FEAT_CTE}, m AS (SELECT avg((volume <= 40)::INT) AS r, var_samp(sentiment / 1e6) AS v FROM feat)
    SELECT * FROM (SELECT unnest(['return_1d', 'alias_1d', 'mostly_null', 'constant', 'tiny', 'sentiment', 'volume']) AS feature,
    unnest([0, 1, 2, 3, 4, 5, 6])::INT AS place, unnest([NULL, 'Duplicate feature vector',
    printf('Excessive missing values (%.1f%%)', r * 100), 'Constant feature (zero variance)',
    printf('Near-constant feature (variance %.2e < 1.00e-06)', v), NULL, NULL]) AS reason FROM m)""",
)
def _(t):
    return quality.quality_gate(_quality_frame(t), _QCOLS)


@query(
    "column_quality",
    f"""WITH {FEAT_CTE}, u AS (SELECT 'return_20d' AS feature, return_20d AS x FROM feat UNION ALL
      SELECT 'volume', volume FROM feat UNION ALL SELECT 'future_return_5d', future_return_5d FROM feat)
    SELECT feature, {R("avg((x IS NULL)::INT)", "missing_ratio")}, {R("min(x)", "low")}, {R("max(x)", "high")},
    {R("var_samp(x)", "variance")} FROM u GROUP BY 1""",
)
def _(t):
    table = quality.feature_quality(features(t), ["return_20d", "volume", "future_return_5d"])
    return tidy(table.drop("place", "mark_a", "mark_b"))


@query(
    "temporal_order",
    """WITH e AS (SELECT user_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id), true) AS by_value,
      coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), true) AS by_id FROM events)
    SELECT user_id, bool_and(by_id) AS ordered, bool_and(by_value) AS value_ordered FROM e GROUP BY 1""",
)
def _(t):
    events = t["events"].withColumn("place", F.struct("value", "event_id"))
    by_id = quality.temporal_order(events, "event_id", ["user_id"], "ts")
    by_value = quality.temporal_order(events, "place", ["user_id"], "ts").withColumnRenamed("ordered", "value_ordered")
    return by_id.join(by_value, "user_id")


@query(
    "feature_availability",
    """SELECT o_orderpriority, bool_and(o_orderdate < l_shipdate) AS available, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t):
    pairs = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return quality.available_in_time(pairs, "o_orderdate", "l_shipdate", ["o_orderpriority"])


@query(
    "feature_lag_check",
    """WITH s AS (SELECT 'f' || n_nationkey || CASE WHEN n_nationkey % 4 = 0 THEN '_future' ELSE '' END AS name, (n_nationkey % 5 - 1)::INT AS lag
      FROM nation)
    SELECT name, lag, CASE WHEN lag < 0 THEN 'negative lag' ELSE 'zero lag on target-like name' END AS issue
    FROM s WHERE lag < 0 OR (lag = 0 AND contains(name, 'future'))""",
)
def _(t):
    future = F.when(F.col("n_nationkey") % 4 == 0, "_future").otherwise("")
    name = F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), future)
    lag = (F.col("n_nationkey") % 5 - 1).cast("int")
    return quality.bad_lags(t["nation"].select(name.alias("name"), lag.alias("lag")))


@query(
    "target_columns",
    f"""WITH {FEAT_CTE} SELECT symbol, count(*) AS n, {R("avg(future_return_5d)", "label")}, 'future_volume' AS found FROM feat GROUP BY 1""",
)
def _(t):
    """Columns that name the future beside the label are reported."""
    rows = features(t).withColumn("future_volume", F.col("return_5d"))
    found = ",".join(quality.target_contamination(rows))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("future_return_5d").alias("label"))
    return tidy(out.withColumn("found", F.lit(found)))


SESSION_SQL = f"""WITH {TICKS_CTE}, g AS (SELECT *, abs({chg('close', 1)}) AS gap FROM ticks WINDOW w AS ({W})),
 s AS (SELECT "timestamp", count(DISTINCT symbol) AS symbols, count(*) FILTER (WHERE gap > 0.2) AS gaps,
  max(gap) FILTER (WHERE gap > 0.2) AS largest_gap, count(*) FILTER (WHERE volume <= 0) AS nv FROM g GROUP BY 1)
SELECT "timestamp", symbols, gaps, {R("largest_gap")}, nv = 0 AND gaps = 0 AS valid FROM s"""


@query("session_validation", SESSION_SQL + ' WHERE "timestamp" = (SELECT max("timestamp") FROM ticks)')
def _(t):
    return tidy(quality.session_issues(t.ticks).drop("reasons"))


@query("session_validation_history", SESSION_SQL)
def _(t):
    return tidy(quality.session_issues(t.ticks, per_session=True).drop("reasons"))


def _reasons_sql(where: str) -> str:
    gap = 'abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY "timestamp"), 0) - 1)'
    checks = " UNION ALL ".join(f"""SELECT "timestamp", '{c}' AS "check", symbol, NULL::DOUBLE AS value FROM g WHERE {c} IS NULL""" for c in ("open", "high", "low", "close", "volume"))
    return f"""g AS (SELECT * FROM (SELECT *, {gap} AS gap FROM thin) {where}), rs AS ({checks}
      UNION ALL SELECT "timestamp", 'no_volume', symbol, volume FROM g WHERE volume <= 0
      UNION ALL SELECT "timestamp", 'gap', symbol, gap FROM g WHERE gap > 0.2)"""


# ticks with some values taken out, and a universe that the latest session does not cover
_THIN = f"""{TICKS_CTE}, thin AS (SELECT symbol, "timestamp", open, high, low, CASE WHEN volume = 3 THEN NULL ELSE close END AS close,
  CASE WHEN high - low > 150 THEN 0 ELSE volume END AS volume FROM ticks)"""


def _thin(t):
    volume = F.when(F.col("high") - F.col("low") > 150, 0.0).otherwise(F.col("volume"))
    return t.ticks.withColumns({"close": F.when(F.col("volume") != 3, F.col("close")), "volume": volume})


@query(
    "session_reasons",
    f"""WITH {_THIN}, m AS (SELECT max("timestamp") AS m FROM thin), {_reasons_sql('WHERE "timestamp" = (SELECT m FROM m)')},
    ex AS (SELECT DISTINCT symbol FROM thin WHERE right(symbol, 1) = '7')
    SELECT "timestamp", "check", symbol, {R('value')} FROM rs UNION ALL SELECT m, 'absent', symbol, NULL FROM ex, m
    WHERE symbol NOT IN (SELECT symbol FROM thin WHERE "timestamp" = m) AND EXISTS (SELECT 1 FROM ex e JOIN thin h ON e.symbol = h.symbol AND h."timestamp" = m)""",
)
def _(t):
    bars = _thin(t)
    return tidy(quality.session_reasons(bars, bars.where(F.col("symbol").endswith("7"))))


@query("session_reasons_history", f"""WITH {_THIN}, {_reasons_sql('')} SELECT "timestamp", "check", symbol, {R('value')} FROM rs""")
def _(t):
    return tidy(quality.session_reasons(_thin(t), per_session=True))


@query(
    "dataset_profile",
    f"""WITH {BARS_CTE}, b AS (SELECT "timestamp", avg(close) AS nifty_close FROM bars GROUP BY 1)
    SELECT count(*) AS n_rows, 11::BIGINT AS n_columns, count(DISTINCT symbol) AS n_symbols, min("timestamp") AS first_date,
    max("timestamp") AS last_date, {R("avg((nifty_close <> close)::INT)", "bench_differs")},
    {R("avg((sentiment <> 0)::INT)", "sentiment_nonzero")} FROM bars JOIN b USING ("timestamp")""",
)
def _(t):
    bars = t.bars.withColumnRenamed("sentiment", "news_sentiment")
    bench = bars.groupBy("timestamp").agg(F.avg("close").alias("nifty_close"))
    return tidy(quality.dataset_profile(bars.join(bench, "timestamp")))


# --- folds --------------------------------------------------------------------------

FOLD_CTES = f"""{DATES.format(src='bars')}, ck AS (SELECT "timestamp", date_idx, ntile(6) OVER (ORDER BY "timestamp") - 1 AS chunk FROM dates),
  st AS (SELECT chunk AS fold, min(date_idx) AS test_start FROM ck WHERE chunk > 0 GROUP BY 1)"""


def fold_sql(condition: str) -> str:
    return f"""WITH {BARS_CTE}, {FOLD_CTES}, f AS (
      SELECT fold, 'train' AS role, "timestamp", date_idx FROM ck, st WHERE {condition} AND date_idx < test_start - 6
      UNION ALL SELECT chunk, 'test', "timestamp", date_idx FROM ck WHERE chunk > 0)
    SELECT fold::INT AS fold, role, count(*) AS n_dates, min("timestamp") AS first_date, max("timestamp") AS last_date,
      min(date_idx) AS first_idx, max(date_idx) AS last_idx FROM f GROUP BY 1, 2"""


def _fold_summary(df):
    return df.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("timestamp").alias("first_date"),
        F.max("timestamp").alias("last_date"),
        F.min("date_idx").alias("first_idx"),
        F.max("date_idx").alias("last_idx"),
    )


@query("embargoed_folds", fold_sql("chunk < fold"))
def _(t):
    return _fold_summary(folds.fold_dates(t.bars))


@query("rolling_folds", fold_sql("chunk = fold - 1"))
def _(t):
    return _fold_summary(folds.fold_dates(t.bars, expanding=False))


@query(
    "holdout_split",
    f"""WITH {BARS_CTE}, l AS (SELECT max("timestamp") AS m FROM bars) SELECT CASE WHEN "timestamp" >= m - INTERVAL 9 MONTH
    THEN 'holdout' ELSE 'validation' END AS part, count(*) AS n, min("timestamp") AS first_date, max("timestamp") AS last_date
    FROM bars, l GROUP BY 1""",
)
def _(t):
    df = t.bars.join(folds.holdout_split(t.bars), "timestamp")
    return df.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_date"), F.max("timestamp").alias("last_date")
    )


@query(
    "holdout_split_short",
    f"""WITH {TICKS_CTE}, {DATES.format(src='ticks')}, c AS (SELECT *, count(*) OVER () AS n FROM dates)
    SELECT "timestamp", date_idx, CASE WHEN date_idx >= greatest(2, floor(n * 0.8e0)) THEN 'holdout' ELSE 'validation' END AS part
    FROM c""",
)
def _(t):
    return folds.holdout_split(t.ticks)


# --- drift --------------------------------------------------------------------------

DRIFT_FEATURES = ["close", "volume", "sentiment", "return_1d", "future_return_5d"]
CUT = "1999-06-01"
DRIFT_CTES = f"""{FEAT_CTE}, both_ AS (SELECT feature, "timestamp" < TIMESTAMP '{CUT}' AS is_ref, x FROM
   feat UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(DRIFT_FEATURES)})))"""
# measures over rows (feature, is_ref, x)
MEASURES = f""" sp AS (SELECT feature, min(coalesce(x, 0)) AS lo, max(coalesce(x, 0)) AS hi FROM both_ WHERE is_ref GROUP BY 1),
 pl AS (SELECT feature, is_ref, {' + '.join(f'(coalesce(x, 0) >= lo + {i} * ((hi - lo) / 10))::INT' for i in range(1, 10))} AS bin
   FROM both_ JOIN sp USING (feature)),
 tot AS (SELECT feature, count(*) FILTER (WHERE is_ref) AS nr, count(*) FILTER (WHERE NOT is_ref) AS nc FROM both_ GROUP BY 1),
 bc AS (SELECT feature, bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM pl GROUP BY 1, 2),
 sh AS (SELECT feature, greatest(r / nr::DOUBLE, 1e-6) AS e, greatest(c / nc::DOUBLE, 1e-6) AS a FROM bc JOIN tot USING (feature)),
 psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY 1),
 v AS (SELECT feature, x, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM both_
   WHERE x IS NOT NULL GROUP BY 1, 2),
 vc AS (SELECT feature, sum(r) OVER z AS ur, sum(c) OVER z AS uc, sum(r) OVER (PARTITION BY feature) AS nr,
   sum(c) OVER (PARTITION BY feature) AS nc FROM v WINDOW z AS (PARTITION BY feature ORDER BY x)),
 ksd AS (SELECT feature, max(abs(ur / nr - uc / nc)) AS ks_stat, any_value(nr) * any_value(nc) / (any_value(nr) + any_value(nc))
   * max(abs(ur / nr - uc / nc)) ** 2 AS z FROM vc GROUP BY 1),
 ks AS (SELECT feature, ks_stat, CASE WHEN z < 0.02 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101),
   lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2e0 * k * k * z))))) END AS ks_pvalue FROM ksd),
 mo AS (SELECT feature, avg(x) FILTER (WHERE NOT is_ref) - avg(x) FILTER (WHERE is_ref) AS mean_change,
   stddev_samp(x) FILTER (WHERE NOT is_ref) - stddev_samp(x) FILTER (WHERE is_ref) AS std_change,
   avg((x IS NULL)::INT) FILTER (WHERE NOT is_ref) - avg((x IS NULL)::INT) FILTER (WHERE is_ref) AS missing_ratio_change
   FROM both_ GROUP BY 1)"""
DRIFT_CTES = f"{DRIFT_CTES}, {MEASURES}"
REPORT_SQL = f"""SELECT feature, {RS('mean_change std_change missing_ratio_change psi ks_stat ks_pvalue')},
    CASE WHEN psi >= 0.25 OR ks_pvalue < 0.01 THEN 'HIGH' WHEN psi >= 0.1 OR ks_pvalue < 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS status,
    CASE WHEN psi >= 0.25 OR ks_pvalue < 0.01 THEN 'Investigate data feed / Retrain model immediately'
     WHEN psi >= 0.1 OR ks_pvalue < 0.05 THEN 'Monitor closely / Schedule retrain' ELSE 'No action required' END AS recommended_action
    FROM mo JOIN psi USING (feature) JOIN ks USING (feature)"""


def _sides(t):
    # read for either side
    df = written(features(t).select("timestamp", *DRIFT_FEATURES), "features")
    old = F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz")
    return df.where(old), df.where(~old)


@query("population_stability", f"WITH {DRIFT_CTES} SELECT feature, {R('psi')} FROM psi")
def _(t):
    return tidy(drift.population_stability(drift.stacked(*_sides(t), DRIFT_FEATURES)))


@query("kolmogorov_smirnov", f"WITH {DRIFT_CTES} SELECT feature, {RS('ks_stat ks_pvalue')} FROM ks")
def _(t):
    return tidy(drift.kolmogorov_smirnov(written(drift.stacked(*_sides(t), DRIFT_FEATURES), "value-counts")))


@query("drift_report", f"WITH {DRIFT_CTES} {REPORT_SQL}")
def _(t):
    return tidy(drift.drift_table(*_sides(t), DRIFT_FEATURES))


@query(
    "drift_gate",
    f"""WITH {DRIFT_CTES}, g AS (SELECT count(*) FILTER (WHERE psi > 0.25) AS breaches FROM psi)
    SELECT any_value(nc) AS current_rows, any_value(breaches) AS breaches, CASE WHEN any_value(nc) < 100 THEN 'SKIP'
    WHEN any_value(breaches) >= 3 THEN 'HIGH' ELSE 'OK' END AS status FROM tot, g""",
)
def _(t):
    return drift.drift_gate(*_sides(t), DRIFT_FEATURES)


@query(
    "drift_evaluation_window",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp", {R('return_5d')} FROM feat
    WHERE "timestamp" > (SELECT max("timestamp") FROM feat) - INTERVAL 60 DAY""",
)
def _(t):
    return tidy(drift.evaluation_window(features(t).select(*KEYS, "return_5d")))


# --- rows ----------------------------------------------------------------------------

_BAD = "CASE WHEN user_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN user_id % 11 = 0 THEN 'Infinity'::DOUBLE WHEN user_id % 13 = 0 THEN NULL ELSE value END"


@query(
    "sanitize",
    f"""WITH b AS (SELECT event_id, {_BAD} AS x FROM events) SELECT event_id,
    {R("least(greatest(CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END, -1e30), 1e30)", "x")} FROM b""",
)
def _(t):
    user = F.col("user_id")
    x = (
        F.when(user % 7 == 0, F.lit(float("nan")))
        .when(user % 11 == 0, F.lit(float("inf")))
        .when(user % 13 != 0, F.col("value"))
    )
    return tidy(rows.sanitize(t["events"].select("event_id", x.alias("x")), ["x"]))


@query(
    "labelled_rows",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp", {R('future_return_5d')} FROM feat WHERE future_return_5d IS NOT NULL""",
)
def _(t):
    return tidy(rows.complete_rows(features(t), ["future_return_5d"]).select(*KEYS, "future_return_5d"))


@query(
    "latest_session",
    f"""WITH {TICKS_CTE} SELECT symbol, "timestamp", {R('close')} FROM ticks
    WHERE "timestamp" = (SELECT max("timestamp") FROM ticks)""",
)
def _(t):
    return tidy(rows.latest_session(t.ticks).select(*KEYS, "close"))


@query(
    "next_session",
    f"""WITH {BARS_CTE}, d AS (SELECT DISTINCT "timestamp"::DATE AS "day" FROM bars)
    SELECT "day", lead("day") OVER (ORDER BY "day") AS next_day FROM d""",
)
def _(t):
    return rows.next_sessions(t.bars)


@query(
    "session_after",
    f"""WITH {BARS_CTE} SELECT min("timestamp"::DATE) AS next_day FROM bars WHERE "timestamp"::DATE > DATE '1999-02-27'""",
)
def _(t):
    return rows.session_after(t.bars, "1999-02-27")


_SIGNAL = "CASE WHEN abs(return_5d) > 0.8 THEN return_5d ELSE 0 END"


@query(
    "active_dates",
    f"""WITH {FEAT_CTE}, s AS (SELECT symbol, "timestamp", {_SIGNAL} AS prediction FROM feat) SELECT symbol, "timestamp",
    {R('prediction')} FROM s QUALIFY bool_or(prediction <> 0) OVER (PARTITION BY "timestamp")""",
)
def _(t):
    signal = F.when(F.abs("return_5d") > 0.8, F.col("return_5d")).otherwise(0.0)
    return tidy(rows.active_dates(features(t).select(*KEYS, signal.alias("prediction")), "prediction"))


@query(
    "rebalance_dates",
    f"""WITH {FEAT_CTE}, {DATES.format(src='feat')} SELECT "timestamp", date_idx FROM dates WHERE date_idx % 5 = 0
    AND "timestamp" IN (SELECT "timestamp" FROM feat WHERE future_return_5d > 0.5)""",
)
def _(t):
    signal = F.when(F.col("future_return_5d") > 0.5, 1.0)
    return rows.rebalance_dates(features(t).select(*KEYS, signal.alias("s")), "s")


@query(
    "trading_days",
    """SELECT date_trunc('day', ts)::DATE AS "day", count(*) AS n FROM events WHERE isodow(ts) < 6
    AND ts::DATE NOT IN (DATE '2024-01-22', DATE '2024-01-26') GROUP BY 1""",
)
def _(t):
    kept = rows.trading_days(t["events"], "ts")
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "watchlist",
    f"""WITH {BARS_CTE} SELECT symbol, count(*) AS n, {R("avg(close)", "mean_close", 4)} FROM bars WHERE symbol IN
    (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier WHERE s_acctbal > 5000) GROUP BY 1""",
)
def _(t):
    names = t["supplier"].where("s_acctbal > 5000").select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("symbol")
    )
    kept = rows.watchlist(t.bars, names)
    return tidy(kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")), 4)


@query(
    "last_rows_per_symbol",
    f"""WITH {BARS_CTE} SELECT symbol, "timestamp", {R('close')} FROM bars
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 31""",
)
def _(t):
    return tidy(rows.last_rows(t.bars.select(*KEYS, "close"), 31))


@query(
    "top_features",
    f"WITH {SCORE_CTES} SELECT feature, {R('score')} FROM sc ORDER BY score DESC, feature LIMIT 4",
)
def _(t):
    return tidy(rows.top_rows(scored(t).select("feature", "score"), 4, "score", "feature"))


@query(
    "top_names_per_date",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp", {R('return_5d')} FROM feat QUALIFY
    rank() OVER (PARTITION BY "timestamp" ORDER BY return_5d DESC) + (count(*) OVER (PARTITION BY "timestamp", return_5d) - 1) / 2e0 <= 5""",
)
def _(t):
    ranked = average_rank(features(t).select(*KEYS, "return_5d"), "return_5d", "place", ["timestamp"], descending=True)
    return tidy(ranked.where("place <= 5").drop("place"))


@query(
    "union_of_panels",
    f"""WITH {BARS_CTE}, {TICKS_CTE}, u AS (SELECT 'daily' AS source, symbol, close FROM bars UNION ALL
    SELECT 'ticks', symbol, close FROM ticks) SELECT source, count(*) AS n, count(DISTINCT symbol) AS symbols,
    {R("max(close)", "top")} FROM u GROUP BY 1""",
)
def _(t):
    both = t.bars.withColumn("source", F.lit("daily")).unionByName(
        t.ticks.withColumn("source", F.lit("ticks")), allowMissingColumns=True
    )
    return tidy(
        both.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.max("close").alias("top")
        )
    )


@query(
    "symbol_changes",
    f"""WITH {TICKS_CTE}, a AS (SELECT DISTINCT symbol FROM ticks WHERE "timestamp" < TIMESTAMP '2024-01-02'),
    b AS (SELECT DISTINCT symbol FROM ticks WHERE "timestamp" >= TIMESTAMP '2024-01-30')
    SELECT symbol, 'missing' AS change FROM a WHERE symbol NOT IN (SELECT symbol FROM b)
    UNION ALL SELECT symbol, 'new' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)
    UNION ALL SELECT symbol, 'kept' FROM a WHERE symbol IN (SELECT symbol FROM b)""",
)
def _(t):
    ticks = t.ticks
    early = ticks.where(F.col("timestamp") < F.lit("2024-01-02").cast("timestamp_ntz"))
    late = ticks.where(F.col("timestamp") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    return rows.symbol_changes(early, late)


@query(
    "first_row_per_key",
    """SELECT l_orderkey, arg_min(l_partkey, {'l': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice}) AS l_partkey,
    min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1""",
)
def _(t):
    lines = t["lineitem"].withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    first = rows.first_per_key(lines.select("l_orderkey", "l_partkey", "l_linenumber", "place"), ["l_orderkey"], "place")
    return first.drop("place")


@query(
    "seeded_sample",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp", {R('return_5d')} FROM feat
    ORDER BY md5('42|' || symbol || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S')), symbol, "timestamp" LIMIT 5000""",
)
def _(t):
    return tidy(rows.seeded_sample(features(t), 5000, KEYS).select(*KEYS, "return_5d"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "wide_and_long",
    """WITH m AS (SELECT l_shipdate AS "timestamp", r_name AS symbol, max(l_quantity) AS q FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY 1, 2) SELECT symbol, "timestamp", q FROM m""",
)
def _(t):
    """Pivot to one column per region and back."""
    lines = (
        t["lineitem"]
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("l_shipdate").alias("timestamp"), F.col("r_name").alias("symbol"))
        .agg(F.max("l_quantity").alias("q"))
    )
    wide = rows.wide_by_symbol(lines, "q", _REGIONS)
    return rows.long_by_symbol(wide, _REGIONS, "q")


