"""Queries over files, models, whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelark.operators import folds as fold_ops
from panelark.operators import models, price, selection
from panelark.plans import research
from panelark.plans.catalog_features import KEYS, LABEL, W, chg
from panelark.plans.catalog_inference import FEAT_CTE, MEASURES, features, ic_ctes
from panelark.plans.registry import BARS_CTE, TICKS_CTE, R, RS, query, tidy
from panelark.session import cut_lineage, scratch_path
from panelark.sources import files, sinks
from panelark.streaming import jobs

# --- files ------------------------------------------------------------------------------


def _vendor_files(t) -> str:
    """Bars as CSV in two vendor layouts, one with other names, without open, high and low, and with many columns before them."""
    folder = scratch_path(t.spark, "vendor")
    bars = t.bars
    full = bars.where("symbol < 'S000050'").select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("Date"), F.col("symbol").alias("Symbol"),
        F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("close").alias("Close"), F.col("volume").alias("Volume"),
    )
    slim = bars.where("symbol >= 'S000050'").select(
        *[F.lit("x").alias(f"Field {i}") for i in range(70)],
        F.col("volume").cast("string").alias("Volume"), F.lit("n/a").alias("Turnover"), F.col("close").alias("Last"),
        F.col("symbol").alias("Ticker"), F.col("timestamp").alias("Trade Date"), F.col("sentiment").alias("News Sentiment"),
    )
    sinks.write_csv(full, f"{folder}/full")
    sinks.write_csv(slim, f"{folder}/slim")
    return folder


CSV_SQL = f"""WITH {BARS_CTE}, c AS (SELECT *, symbol >= 'S000050' AS slim FROM bars) SELECT symbol, "timestamp",
  CASE WHEN slim THEN close ELSE open END AS open, CASE WHEN slim THEN close ELSE high END AS high,
  CASE WHEN slim THEN close ELSE low END AS low, close, volume, CASE WHEN slim THEN sentiment ELSE 0 END AS sentiment,
  0e0 AS positive_news, NULL::DOUBLE AS turnover FROM c"""
CSV_SQL = f"""SELECT symbol, "timestamp", {RS('open high low close volume sentiment positive_news turnover')} FROM ({CSV_SQL})"""
CSV_COLUMNS = ["open", "high", "low", "close", "volume", "sentiment", "positive_news", "turnover"]


@query("csv_bar_scan", CSV_SQL)
def _(t):
    folder = _vendor_files(t)
    bars = price.with_ohlc(files.read_bars(t.spark, [f"{folder}/full", f"{folder}/slim"]))
    return tidy(bars.select(*KEYS, *CSV_COLUMNS))


@query(
    "news_scan",
    f"""WITH {BARS_CTE} SELECT symbol, "timestamp", 'close at ' || floor(close)::BIGINT AS headline, {R("sentiment", "news_sentiment")},
    {R("CASE WHEN symbol < 'S000050' THEN positive_news ELSE 0 END", "positive_news")} FROM bars""",
)
def _(t):
    """CSV and JSON news below one folder."""
    folder = scratch_path(t.spark, "news")
    text = F.concat(F.lit("close at "), F.floor("close").cast("string"))
    bars = t.bars
    csv = bars.where("symbol < 'S000050'").select(
        F.col("timestamp").alias("published_at"), F.lower("symbol").alias("Ticker"), text.alias("Article"),
        F.col("sentiment").alias("Sentiment"), F.col("positive_news").alias("Positive News"),
    )
    json = bars.where("symbol >= 'S000050'").select(
        "timestamp", F.lower("symbol").alias("company"), text.alias("text"), F.col("sentiment").alias("news_sentiment")
    )
    sinks.write_csv(csv, f"{folder}/a/csv")
    json.write.json(f"{folder}/b/json")
    news = files.read_news(t.spark, [folder, f"{folder}/absent"], json_lines=True)
    return tidy(news.select(*KEYS, "headline", "news_sentiment", "positive_news"))


@query(
    "benchmark_scan",
    f"""WITH {BARS_CTE}, k AS (SELECT "timestamp", close, volume, row_number() OVER (PARTITION BY "timestamp" ORDER BY symbol) AS n FROM bars)
    SELECT "timestamp", {R("close", "index_close")}, {R("volume", "index_volume")} FROM k WHERE n = 1""",
)
def _(t):
    """The first row per timestamp in file order wins."""
    folder = scratch_path(t.spark, "bench")
    rows = t.bars.select(
        F.col("timestamp").alias("Trade_Date"), F.col("close").alias("Index Value"), F.col("volume").alias("Volume"), "symbol"
    )
    sinks.write_csv(rows.orderBy("symbol"), folder)
    return tidy(files.read_benchmark(t.spark, folder, "INDEX"))


@query(
    "dated_signal_sink",
    f"""WITH {FEAT_CTE} SELECT symbol, "timestamp" AS signal_date, {R("-return_5d", "prediction")} FROM feat
    WHERE "timestamp" = (SELECT max("timestamp") FROM feat)""",
)
def _(t):
    """All dates are written, the last one again; the reader sees the last date once."""
    folder = scratch_path(t.spark, "signals")
    signal = (-F.col("return_5d")).alias("prediction")
    # written twice and asked for its last date
    rows = cut_lineage(features(t).select("symbol", F.col("timestamp").alias("signal_date"), signal))
    sinks.write_signals(rows, folder)
    sinks.write_signals(rows.where(F.to_date("signal_date") == rows.agg(F.max(F.to_date("signal_date"))).scalar()), folder)
    return tidy(sinks.latest_signals(t.spark, folder))


@query(
    "bar_sink",
    f"""WITH {BARS_CTE} SELECT date_trunc('month', "timestamp")::DATE AS "date", count(*) AS n, count(DISTINCT symbol) AS symbols,
    {R("sum(close)", "closes", 4)}, true AS in_order FROM bars GROUP BY 1""",
)
def _(t):
    """Bars written by month and read back: totals, and whether rows of each file stand in order of symbol and time."""
    folder = scratch_path(t.spark, "bars")
    sinks.write_bars(t.bars, folder, unit="month")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    rows = t.spark.read.parquet(folder).select("date", *KEYS, "close", *place)
    within = Window.partitionBy("file").orderBy("place")
    before = F.lag(F.struct(*KEYS)).over(within)
    placed = rows.withColumn("ok", F.coalesce(before <= F.struct(*KEYS), F.lit(True)))
    totals = [F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.sum("close").alias("closes")]
    return tidy(placed.groupBy("date").agg(*totals, F.bool_and("ok").alias("in_order")), 4)


@query(
    "json_summary_sink",
    f"""WITH {BARS_CTE} SELECT symbol, count(*) AS n, {R("max(close)", "top")} FROM bars GROUP BY 1""",
)
def _(t):
    folder = scratch_path(t.spark, "summary")
    metrics = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))
    sinks.write_summary(metrics, folder)
    return tidy(t.spark.read.schema("symbol string, n bigint, top double").json(folder))


# --- models -----------------------------------------------------------------------------

MODEL_FEATURES = ["return_1d", "return_5d", "return_20d", "volume_change", "sentiment", "norm_atr_14"]


def model_frame(t):
    wide = price.price_features(
        t.ticks, [price.add_returns, price.add_atr, price.add_momentum, price.add_volume, price.add_label]
    )
    return cut_lineage(wide.select(*KEYS, "open", "high", "low", "close", "volume", *MODEL_FEATURES, "momentum_12_1", "future_return_5d"))


FOLD_RULE = f"""{TICKS_CTE}, tf AS (SELECT symbol, "timestamp", {chg('close', 5)} AS r5, {LABEL} AS y FROM ticks WINDOW w AS ({W})),
  dt AS (SELECT "timestamp", ntile(6) OVER (ORDER BY "timestamp") - 1 AS fold FROM (SELECT DISTINCT "timestamp" FROM ticks)),
  pd AS (SELECT fold, "timestamp", -coalesce(r5, 0) / 10 AS x, y FROM tf JOIN dt USING ("timestamp") WHERE fold > 0)"""


def _rule_predictions(t):
    df = price.price_features(t.ticks, [price.add_returns, price.add_label])
    dates = fold_ops.fold_dates(t.ticks).where("role = 'test'").select("fold", "timestamp")
    return df.join(dates, "timestamp").select(
        "fold", *KEYS, (-F.col("return_5d") / 10).alias("prediction"), "future_return_5d"
    )


@query(
    "fold_metrics",
    f"""WITH {FOLD_RULE}, {ic_ctes('pd', 'fold, "timestamp"')}, m AS (SELECT fold, avg(ic) AS ic FROM ic GROUP BY 1),
    e AS (SELECT fold, sqrt(avg((x - y) ** 2)) AS rmse FROM pd WHERE y IS NOT NULL GROUP BY 1)
    SELECT fold::INT AS fold, {R("coalesce(ic, 0)", "ic")}, {R("rmse")} FROM e LEFT JOIN m USING (fold)""",
)
def _(t):
    return tidy(models.fold_metrics(_rule_predictions(t)))


@query(
    "pooled_metrics",
    f"""WITH {FOLD_RULE} SELECT count(*) AS n, {R("sqrt(avg((y - x) ** 2))", "rmse")}, {R("1 - avg((y - x) ** 2) / var_pop(y)", "r2")},
    {R("avg((sign(x) = sign(y))::INT)", "hit_rate")} FROM pd WHERE y IS NOT NULL""",
)
def _(t):
    return tidy(models.pooled_metrics(_rule_predictions(t)))


@query("walk_forward_forest")
def _(t):
    return tidy(models.walk_forward(model_frame(t), MODEL_FEATURES, splits=4))


@query("baseline_forest")
def _(t):
    df = model_frame(t)
    model, names = models.baseline_model(df)
    return tidy(models.predict(model, df, names).select(*KEYS, "prediction"))


@query("tree_importance")
def _(t):
    return tidy(models.tree_importance(model_frame(t), MODEL_FEATURES))


@query("nested_walk_forward")
def _(t):
    predictions, _chosen = models.nested_walk_forward(model_frame(t), MODEL_FEATURES, splits=3, top_k=4)
    return tidy(predictions)


@query("sentiment_ablation")
def _(t):
    """Nested walk-forward with and without the sentiment inputs."""
    df = model_frame(t).withColumnRenamed("sentiment", "sentiment_raw")
    names = [f if f != "sentiment" else "sentiment_raw" for f in MODEL_FEATURES]
    out = None
    for label, chosen in (("with", names), ("without", selection.without_sentiment(names))):
        predictions, _ = models.nested_walk_forward(df, chosen, splits=3, top_k=4)
        part = models.pooled_metrics(predictions).withColumn("inputs", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


RANKED = ["return_5d", "return_5d_again", "return_1d", "return_20d", "sentiment"]


def _pruned_sql() -> str:
    """A feature is kept if no feature kept before it correlates with it above the limit."""
    value = {f: f if f != "return_5d_again" else "2 * return_5d" for f in RANKED}
    pairs = ", ".join(f"abs(corr({value[a]}, {value[b]})) > 0.9 AS c{i}_{j}" for j, b in enumerate(RANKED) for i, a in enumerate(RANKED[:j]))
    steps, name = [f"m AS (SELECT {pairs}, true AS k0 FROM feat)"], "m"
    for j in range(1, len(RANKED)):
        hit = " OR ".join(f"(k{i} AND c{i}_{j})" for i in range(j))
        steps.append(f"m{j} AS (SELECT *, NOT ({hit}) AS k{j} FROM {name})")
        name = f"m{j}"
    rows = " UNION ALL ".join(f"SELECT {j} AS r, '{f}' AS feature FROM {name} WHERE k{j}" for j, f in enumerate(RANKED))
    return f"WITH {FEAT_CTE}, {', '.join(steps)} SELECT (row_number() OVER (ORDER BY r) - 1)::INT AS place, feature FROM ({rows})"


@query("redundancy_pruning", _pruned_sql())
def _(t):
    """Position of each feature that survives the correlation limit."""
    df = features(t).withColumn("return_5d_again", F.col("return_5d") * 2)
    kept = selection.prune_redundant(df, RANKED)
    return t.spark.createDataFrame(list(enumerate(kept)), "place int, feature string")


@query("holdout_evaluation")
def _(t):
    df = model_frame(t)
    parts = fold_ops.holdout_split(df)
    tagged = df.join(parts.select("timestamp", "part"), "timestamp")
    validation = cut_lineage(tagged.where("part = 'validation'").drop("part"))
    return tidy(research.holdout_evaluation(validation, tagged.where("part = 'holdout'").drop("part"), MODEL_FEATURES, 4))


@query("train_save_load_score")
def _(t):
    """Train, save the bundle, load it and score the latest session."""
    from panelark.sources.bundle import load_bundle, save_bundle

    df = model_frame(t)
    folder = scratch_path(t.spark, "bundle")
    save_bundle(research.train_model(df, MODEL_FEATURES), folder)
    return tidy(research.score_universe(df, load_bundle(t.spark, folder))["signals"])


@query("full_feature_matrix")
def _(t):
    df = research.feature_matrix(t.bars)
    return tidy(df.select(*KEYS, *selection.candidate_features(df)))


@query("research_run")
def _(t):
    """Whole research job on the event bars; the comparison table is shown."""
    result = research.run_research(t.ticks, splits=3, top_k=5)
    return tidy(result.tables["comparison"])


# --- streams ----------------------------------------------------------------------------


def _stream(t, name: str):
    """One input table as a file stream."""
    schema = t[name].schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _collected(t, stream, label: str):
    folder = scratch_path(t.spark, label)
    jobs.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


@query("stream_bar_ingest", CSV_SQL)
def _(t):
    """One stream for each vendor layout."""
    folder = _vendor_files(t)
    headers = {
        "full": ["Date", "Symbol", "Open", "High", "Low", "Close", "Volume"],
        "slim": [*[f"Field {i}" for i in range(70)], "Volume", "Turnover", "Last", "Ticker", "Trade Date", "News Sentiment"],
    }
    full, slim = (_collected(t, jobs.bar_stream(t.spark, f"{folder}/{k}", h, files_per_trigger=3), k) for k, h in headers.items())
    return tidy(price.with_ohlc(full.unionByName(slim)).select(*KEYS, *CSV_COLUMNS))


@query(
    "stream_tick_bars",
    """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts)
      AS "timestamp", arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
      count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
    SELECT symbol, "timestamp", open, high, low, close, volume FROM b, m WHERE "timestamp" + INTERVAL 1 HOUR <= w""",
)
def _(t):
    """Windows still open at the watermark are not emitted."""
    ticks = _stream(t, "events").withColumnRenamed("event_type", "symbol")
    return _collected(t, jobs.tick_bars(ticks), "ticks").drop("last_tick")


# ticks arrive in three batches that meet within a bar
MEETINGS = ["2024-01-11 00:30:00", "2024-01-21 12:30:00"]


@query(
    "stream_live_bars",
    f"""WITH e AS (SELECT *, {' + '.join(f"(ts >= TIMESTAMP '{d}')::INT" for d in MEETINGS)} AS batch FROM events)
    SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS "timestamp", arg_min(value, ts) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, max(ts) AS last_tick, count(DISTINCT batch) AS versions,
      time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) AS final FROM e GROUP BY ALL""",
)
def _(t):
    """All bars as they stand when the ticks end, those still open included."""
    folder = scratch_path(t.spark, "live")
    ticks = t["events"].select(F.col("event_type").alias("symbol"), "ts", "value")
    batch = sum((F.col("ts") >= F.lit(d).cast("timestamp_ntz")).cast("int") for d in MEETINGS)
    for k in range(len(MEETINGS) + 1):  # files arrive one after the other
        ticks.where(batch == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.live_bars(jobs.tick_bars(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.newest_bars(t.spark, f"{folder}/out")


@query("stream_first_writes", "SELECT DISTINCT o_custkey, o_orderdate FROM orders")
def _(t):
    rows = _stream(t, "orders").select("o_custkey", "o_orderdate")
    kept = _collected(t, jobs.first_writes(rows, ["o_custkey", "o_orderdate"], "o_orderdate"), "writes")
    return kept.select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


# events arrive in three batches; every twentieth of the first two comes one batch later
ARRIVAL = "((ts >= TIMESTAMP '2024-01-11')::INT + (ts >= TIMESTAMP '2024-01-21')::INT)"
STATE_SQL = f"""WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS symbol, ts, value + 100 AS value,
    least(2, {ARRIVAL} + (event_id % 20 = 0)::INT) AS batch FROM events),
  l AS (SELECT *, coalesce(ts <= max(ts) OVER (PARTITION BY symbol ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM a),
  e AS (SELECT symbol, ts AS "timestamp", value, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM l WHERE NOT late),
  r AS (SELECT symbol, k, "timestamp", value, value AS ewm, value AS peak, 0e0 AS drawdown, false AS paused FROM e WHERE k = 1
    UNION ALL SELECT e.symbol, e.k, e."timestamp", e.value, 0.9e0 * r.ewm + 0.1e0 * e.value, greatest(r.peak, e.value),
      e.value / greatest(r.peak, e.value) - 1, r.paused OR e.value / greatest(r.peak, e.value) - 1 <= -0.1
    FROM r JOIN e ON e.symbol = r.symbol AND e.k = r.k + 1)
  SELECT symbol, "timestamp", {RS('value ewm peak drawdown')}, paused, false AS late FROM r
  UNION ALL SELECT symbol, ts, {R('value')}, NULL, NULL, NULL, NULL, true FROM l WHERE late"""


@query("stream_running_state", STATE_SQL)
def _(t):
    """State over three micro-batches, with rows that come late."""
    folder = scratch_path(t.spark, "arrivals")
    day = lambda d: (F.col("ts") >= F.lit(d).cast("timestamp_ntz")).cast("int")
    batch = F.least(F.lit(2), day("2024-01-11") + day("2024-01-21") + (F.col("event_id") % 20 == 0).cast("int"))
    rows = t["events"].select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"), (F.col("value") + 100).alias("value"), batch.alias("batch")
    )
    for k in range(3):
        rows.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = _collected(t, jobs.running_state(stream), "state")
    return tidy(out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


WATCHED = ["close", "volume", "sentiment"]
BORDERS = ["2024-01-15", "2024-01-20", "2024-01-25", "2100-01-01"]  # of the reference and the batches
MONITOR_SQL = f"""WITH {TICKS_CTE}, b AS (SELECT *, {' + '.join(f"""("timestamp" >= TIMESTAMP '{d}')::INT""" for d in BORDERS)} - 1 AS batch FROM ticks),
  g AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY "timestamp"), 0) - 1) AS gap FROM b WHERE batch >= 0),
  s AS (SELECT batch, "timestamp", count(*) AS symbols, count(*) FILTER (WHERE gap > 0.2) AS gaps, max(gap) FILTER (WHERE gap > 0.2) AS largest_gap
    FROM g WHERE "timestamp" = (SELECT max("timestamp") FROM b z WHERE z.batch = g.batch) GROUP BY ALL),
  both_ AS (SELECT feature || '|' || batch AS feature, is_ref, v AS x FROM (
      SELECT k.batch, true AS is_ref, {', '.join(f'b.{c}' for c in WATCHED)} FROM b, (SELECT DISTINCT batch FROM b WHERE batch >= 0) k WHERE b.batch < 0
      UNION ALL SELECT batch, false, {', '.join(WATCHED)} FROM b WHERE batch >= 0)
    UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(WATCHED)}))), {MEASURES},
  d AS (SELECT split_part(feature, '|', 2)::INT AS batch, count(*) FILTER (WHERE psi > 0.25) AS n FROM psi GROUP BY 1),
  c AS (SELECT batch, count(*) AS n FROM b GROUP BY 1)
  SELECT s.batch AS batch_id, "timestamp", symbols, gaps, {R('largest_gap')}, gaps = 0 AS valid, (gaps > 0)::INT AS n_reasons,
    CASE WHEN c.n < 100 THEN 'SKIP' WHEN d.n >= 3 THEN 'HIGH' ELSE 'OK' END AS drift_status FROM s JOIN d USING (batch) JOIN c USING (batch)"""


@query("stream_monitor", MONITOR_SQL)
def _(t):
    """Each micro-batch of bars is validated, also against the batch before, and gated against earlier bars."""
    folder = scratch_path(t.spark, "monitor")
    ticks = t.ticks.select(*KEYS, "open", "high", "low", "close", "volume", "sentiment")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    parts = [ticks.where((F.col("timestamp") >= day(a)) & (F.col("timestamp") < day(b))) for a, b in zip(BORDERS, BORDERS[1:])]
    for part in parts:  # files arrive one after the other
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.monitor(stream, ticks.where(F.col("timestamp") < day(BORDERS[0])), WATCHED, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return tidy(t.spark.read.parquet(f"{folder}/out").drop("batch"))
