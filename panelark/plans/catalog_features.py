"""Queries over the per-symbol feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelark.functions.windows import ewm, over_series
from panelark.operators import cross_asset, price, sentiment
from panelark.plans.registry import BARS_CTE, R, RS, TICKS_CTE, query, tidy
from panelark.sources import synthetic
from panelark.schema import HEADLINES, LEXICON

W = 'PARTITION BY symbol ORDER BY "timestamp"'


def roll(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def chg(c: str, n: int, w: str = "w") -> str:
    return f"({c} / nullif(lag({c}, {n}) OVER {w}, 0) - 1)"


KEYS = ["symbol", "timestamp"]
HEAD = f'WITH {BARS_CTE} SELECT symbol, "timestamp", '
TAIL = f" FROM bars WINDOW w AS ({W})"


PRICE_LEVEL = ("sma_", "raw_macd", "atr_", "ewm_")


def shown(df, names: str):
    """Keys and the named columns; columns in price units keep four digits."""
    out = df.select(*KEYS, *names.split())
    return tidy(out, special={c: 4 for c in out.columns if c.startswith(PRICE_LEVEL)})


def steps(t, *parts):
    return price.price_features(t.bars, list(parts))


RET1 = f"coalesce({chg('close', 1)}, 0)"
returns_sql = HEAD + ", ".join(R(f"coalesce({chg('close', n)}, 0)", f"return_{n}d") for n in price.RETURN_SPANS) + TAIL


@query("returns", returns_sql)
def _(t):
    return shown(steps(t, price.add_returns), " ".join(f"return_{n}d" for n in price.RETURN_SPANS))


def _sma_columns(n):
    mean = f"avg(close) OVER {roll(n)}"
    gap = f"coalesce(close / nullif({mean}, 0) - 1, 0)"
    return [R(mean, f"sma_{n}", 4), R(gap, f"distance_from_sma_{n}"), R(gap, f"norm_sma_{n}")]


@query("moving_averages", HEAD + ", ".join(c for n in price.SMA_SPANS for c in _sma_columns(n)) + TAIL)
def _(t):
    names = " ".join(f"sma_{n} distance_from_sma_{n} norm_sma_{n}" for n in price.SMA_SPANS)
    return shown(steps(t, price.add_moving_averages), names)


_vol = [
    R(f"coalesce(stddev_samp(r) OVER {roll(n)}, 0)", f"{p}std_{n}") for n in price.STD_SPANS for p in ("", "norm_")
] + [R(f"coalesce(stddev_samp(f) OVER {roll(20)}, 0)", "downside_volatility_20")]


@query(
    "volatility",
    f"""WITH {BARS_CTE}, r AS (SELECT symbol, "timestamp", {RET1} AS r,
    CASE WHEN lag(close) OVER w IS NOT NULL THEN least({chg('close', 1)}, 0) END AS f {TAIL})
    SELECT symbol, "timestamp", {", ".join(_vol)} FROM r""",
)
def _(t):
    names = " ".join(f"std_{n} norm_std_{n}" for n in price.STD_SPANS) + " downside_volatility_20"
    return shown(steps(t, price.add_returns, price.add_volatility), names)


NUMBERED = f"numbered AS (SELECT *, row_number() OVER w AS k, lag(close) OVER w AS pc {TAIL})"

RSI_SQL = f"""WITH RECURSIVE {BARS_CTE}, {NUMBERED}, rec AS (
  SELECT symbol, k, "timestamp", close, NULL::DOUBLE AS u, NULL::DOUBLE AS d FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.k, n."timestamp", n.close,
    CASE WHEN r.u IS NULL THEN greatest(n.close - n.pc, 0)
         ELSE r.u * (1 - 1e0 / 14) + greatest(n.close - n.pc, 0) / 14 END,
    CASE WHEN r.d IS NULL THEN -least(n.close - n.pc, 0)
         ELSE r.d * (1 - 1e0 / 14) - least(n.close - n.pc, 0) / 14 END
  FROM rec r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1)
SELECT symbol, "timestamp",
  {R("CASE WHEN k >= 15 THEN coalesce(100 - 100 / (1 + u / nullif(d, 0)), 50) ELSE 50 END", "rsi_14")} FROM rec"""


@query("rsi", RSI_SQL)
def _(t):
    return shown(steps(t, price.add_rsi), "rsi_14")


MACD_SQL = f"""WITH RECURSIVE {BARS_CTE}, {NUMBERED}, rec AS (
  SELECT symbol, k, "timestamp", close, close AS f, close AS s, 0e0 AS g FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.k, n."timestamp", n.close,
    r.f * (11e0 / 13) + n.close * (2e0 / 13), r.s * (25e0 / 27) + n.close * (2e0 / 27),
    r.g * 0.8e0 + 0.2e0 * ((r.f * (11e0 / 13) + n.close * (2e0 / 13)) - (r.s * (25e0 / 27) + n.close * (2e0 / 27)))
  FROM rec r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1)
SELECT symbol, "timestamp", {R("f - s", "raw_macd", 4)}, {R("(f - s) / nullif(close, 0)", "macd")},
  {R("g / nullif(close, 0)", "macd_signal")}, {R("(f - s - g) / nullif(close, 0)", "macd_hist")} FROM rec"""


@query("macd", MACD_SQL)
def _(t):
    return shown(steps(t, price.add_macd), "raw_macd macd macd_signal macd_hist")


TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"


@query(
    "atr",
    f"""WITH {BARS_CTE}, r AS (SELECT *, {TR} AS tr {TAIL})
    SELECT symbol, "timestamp", {R(f"avg(tr) OVER {roll(14)}", "atr_14", 4)},
    {R(f"coalesce(avg(tr) OVER {roll(14)} / nullif(close, 0), 0)", "norm_atr_14")} FROM r""",
)
def _(t):
    return shown(steps(t, price.add_atr), "atr_14 norm_atr_14")


@query(
    "stochastic",
    f"""WITH {BARS_CTE}, r AS (SELECT *, 100 * (close - min(low) OVER {roll(14)})
      / nullif(max(high) OVER {roll(14)} - min(low) OVER {roll(14)}, 0) AS k FROM bars)
    SELECT symbol, "timestamp", {R("coalesce(k, 50)", "stoch_k")},
    {R(f"coalesce(avg(k) OVER {roll(3)}, 50)", "stoch_d")} FROM r""",
)
def _(t):
    return shown(steps(t, price.add_stochastic), "stoch_k stoch_d")


_mom = [R(f"coalesce({chg('close', n)}, 0) * 100", f"roc_{n}") for n in (5, 10, 20)]
_mom += [R(f"coalesce({chg('close', n)}, 0)", f"momentum_{n}") for n in (5, 10, 20)]
_mom += [R("coalesce(lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1, 0)", "momentum_12_1")]


@query("momentum", HEAD + ", ".join(_mom) + TAIL)
def _(t):
    names = "roc_5 roc_10 roc_20 momentum_5 momentum_10 momentum_20 momentum_12_1"
    return shown(steps(t, price.add_returns, price.add_momentum), names)


@query(
    "yearly_extremes",
    HEAD
    + R(f"coalesce(close / nullif(max(high) OVER {roll(252)}, 0) - 1, 0)", "distance_from_52w_high")
    + ", "
    + R(f"coalesce(close / nullif(min(low) OVER {roll(252)}, 0) - 1, 0)", "distance_from_52w_low")
    + " FROM bars",
)
def _(t):
    return shown(steps(t, price.add_extremes), "distance_from_52w_high distance_from_52w_low")


_z = f"""CASE WHEN count(volume) OVER {roll(20)} >= 5 THEN coalesce((volume - avg(volume) OVER {roll(20)})
 / nullif(stddev_samp(volume) OVER {roll(20)}, 0), 0) ELSE 0 END"""


@query(
    "volume_scores",
    HEAD + R(f"coalesce({chg('volume', 1)}, 0)", "volume_change") + ", " + R(_z, "volume_zscore") + TAIL,
)
def _(t):
    return shown(steps(t, price.add_volume), "volume_change volume_zscore")


FLOWS = f"""flow AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS sv,
   coalesce({chg('close', 1)}, 0) * volume AS tv {TAIL}),
 cum AS (SELECT *, sum(sv) OVER w AS obv, sum(tv) OVER w AS vpt FROM flow WINDOW w AS ({W}))"""


@query(
    "volume_flows",
    f"""WITH {BARS_CTE}, {FLOWS} SELECT symbol, "timestamp", {R("obv")}, {R("vpt", "volume_price_trend", 4)},
    {R("coalesce((vpt - lag(vpt, 20) OVER w) / (abs(lag(vpt, 20) OVER w) + 1e-6), 0)", "norm_vpt_20d", 4)}
    FROM cum WINDOW w AS ({W})""",
)
def _(t):
    df = price.add_volume_flows(price.with_ohlc(t.bars))
    return tidy(df.select(*KEYS, "obv", "volume_price_trend", "norm_vpt_20d"), 4)


LABEL = "lead(open, 6) OVER w / nullif(lead(open, 1) OVER w, 0) - 1"


@query("forward_label", HEAD + R(LABEL, "future_return_5d") + TAIL)
def _(t):
    return shown(steps(t, price.add_label), "future_return_5d")


EWM_GAPS_SQL = f"""WITH RECURSIVE {BARS_CTE}, gaps AS (SELECT symbol, "timestamp", row_number() OVER w AS k,
    CASE WHEN volume > 10 THEN close END AS x {TAIL}),
  rec AS (SELECT symbol, k, "timestamp", x AS y, CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END AS o, x IS NOT NULL AS started
    FROM gaps WHERE k = 1
  UNION ALL
  SELECT g.symbol, g.k, g."timestamp",
    CASE WHEN NOT r.started THEN g.x WHEN g.x IS NULL THEN r.y
         ELSE (r.o * 0.9e0 * r.y + 0.1e0 * g.x) / (r.o * 0.9e0 + 0.1e0) END,
    CASE WHEN g.x IS NOT NULL THEN 1e0 ELSE r.o * 0.9e0 END, r.started OR g.x IS NOT NULL
  FROM rec r JOIN gaps g ON g.symbol = r.symbol AND g.k = r.k + 1)
SELECT symbol, "timestamp", {R("y", "ewm_close", 4)} FROM rec"""


@query("ewm_with_gaps", EWM_GAPS_SQL)
def _(t):
    thin = t.bars.select(*KEYS, F.when(F.col("volume") > 10, F.col("close")).alias("x"))
    return shown(ewm(thin, "x", 0.1, "ewm_close"), "ewm_close")


# --- cross-asset ---------------------------------------------------------------

BENCH_CTE = 'bench AS (SELECT "timestamp", avg(close) AS nifty_close FROM bars GROUP BY 1)'
_pair = f"""pair AS (SELECT b.*, nifty_close, coalesce({chg('close', 1)}, 0) AS ro, coalesce({chg('nifty_close', 1)}, 0) AS rm
  FROM bars b LEFT JOIN bench USING ("timestamp") WINDOW w AS ({W}))"""
_w20 = roll(20)
_corr = f"""CASE WHEN count(*) OVER {_w20} >= 5 THEN coalesce(covar_pop(ro, rm) OVER {_w20}
  / nullif(stddev_pop(ro) OVER {_w20} * stddev_pop(rm) OVER {_w20}, 0), 0) ELSE 0 END"""
_beta = f"""CASE WHEN count(*) OVER {_w20} >= 5 THEN
  coalesce(covar_samp(ro, rm) OVER {_w20} / nullif(var_samp(rm) OVER {_w20}, 0), 1) ELSE 1 END"""
_cross = [
    R("ro - rm", "relative_return_vs_benchmark"),
    R("close / nullif(nifty_close, 0) - 1", "market_relative_strength"),
    R("close / nullif(nifty_close, 0) - 1", "sector_relative_strength"),
    R(_beta, "rolling_beta"),
    R(_beta, "beta_to_benchmark"),
    R(_corr, "correlation_to_market"),
    f"CASE WHEN nifty_close > avg(nifty_close) OVER {roll(50)} + 1e-9 THEN 1e0 ELSE -1e0 END AS market_regime",
]


@query("cross_asset", f'WITH {BARS_CTE}, {BENCH_CTE}, {_pair} SELECT symbol, "timestamp", {", ".join(_cross)} FROM pair')
def _(t):
    bars = t.bars
    df = cross_asset.cross_asset_features(cross_asset.join_benchmark(bars, cross_asset.market_mean(bars)))
    names = (
        "relative_return_vs_benchmark market_relative_strength sector_relative_strength rolling_beta "
        "beta_to_benchmark correlation_to_market market_regime"
    )
    return shown(df, names)


@query(
    "benchmark_default",
    HEAD + f"{R('0', 'relative_return_vs_benchmark')}, {R('0', 'market_relative_strength')}, -1e0 AS regime_at_start"
    f" FROM bars QUALIFY row_number() OVER ({W}) = 1",
)
def _(t):
    """Without a benchmark column the close itself is the benchmark."""
    df = over_series(t.bars, lambda d, s: d.withColumn("_k", F.row_number().over(s.ordered)), before=0)
    df = cross_asset.cross_asset_features(df).where("_k = 1")
    return tidy(
        df.select(
            *KEYS,
            "relative_return_vs_benchmark",
            "market_relative_strength",
            F.col("market_regime").alias("regime_at_start"),
        )
    )


FILL_SQL = f"""WITH {BARS_CTE}, thin AS (SELECT "timestamp", avg(close) AS nifty_close FROM bars
   GROUP BY 1 HAVING count(*) >= 25),
 j AS (SELECT symbol, "timestamp", nifty_close FROM bars LEFT JOIN thin USING ("timestamp"))
SELECT symbol, "timestamp", {R('''coalesce(last_value(nifty_close IGNORE NULLS) OVER w,
  first_value(nifty_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND
  UNBOUNDED FOLLOWING))''', 'nifty_close')} FROM j WINDOW w AS ({W})"""


@query("benchmark_join_and_fill", FILL_SQL)
def _(t):
    bars = t.bars
    thin = bars.groupBy("timestamp").agg(F.avg("close").alias("nifty_close"), F.count(F.lit(1)).alias("n"))
    return shown(cross_asset.join_benchmark(bars, thin.where("n >= 25").drop("n")), "nifty_close")


SECTOR_CTE = """sectors AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sectors(t):
    return (
        t["supplier"]
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("symbol"),
            F.col("r_name").alias("sector"),
        )
    )


@query(
    "sector_lookup",
    f"""WITH {BARS_CTE}, {SECTOR_CTE} SELECT symbol, "timestamp", coalesce(sector, 'Other') AS sector
    FROM bars LEFT JOIN (SELECT * FROM sectors WHERE sector <> 'ASIA') USING (symbol)""",
)
def _(t):
    lookup = sectors(t).where("sector <> 'ASIA'")
    return cross_asset.tag_sectors(t.bars, lookup).select(*KEYS, "sector")


_SN = f"""WITH {BARS_CTE}, {SECTOR_CTE}, lab AS (SELECT symbol, "timestamp", {LABEL} AS y, {RET1} AS r1,
   coalesce({chg('close', 5)}, 0) AS r5 {TAIL}), j AS (SELECT lab.*, coalesce(sector, 'Other') AS sector
   FROM lab LEFT JOIN sectors USING (symbol)) SELECT symbol, "timestamp", """


def _neutral(c):
    return f'{c} - avg({c}) OVER (PARTITION BY "timestamp", sector)'


@query("sector_neutral_target", _SN + R(_neutral("y"), "future_return_5d_sn") + " FROM j")
def _(t):
    df = cross_asset.tag_sectors(steps(t, price.add_label), sectors(t))
    return shown(cross_asset.sector_neutral(df), "future_return_5d_sn")


@query(
    "sector_demeaned_features",
    _SN + R(_neutral("r1"), "return_1d_sn") + ", " + R(_neutral("r5"), "return_5d_sn") + " FROM j",
)
def _(t):
    df = cross_asset.tag_sectors(steps(t, price.add_returns), sectors(t))
    out = cross_asset.sector_neutral(df, ["return_1d", "return_5d", "symbol"])
    return shown(out, "return_1d_sn return_5d_sn")


# --- text and sentiment ----------------------------------------------------------


def _sent_mean(n):
    return f"avg(sentiment) OVER {roll(n)}"


_sent = [
    R("coalesce(lag(sentiment) OVER w, 0)", "sentiment_1d"),
    R(_sent_mean(3), "sentiment_3d_mean"),
    R(_sent_mean(7), "sentiment_7d_mean"),
    R(_sent_mean(30), "sentiment_30d_mean"),
    R("c", "sentiment_change"),
    R("coalesce(c - lag(c) OVER w, 0)", "sentiment_acceleration"),
    R(f"coalesce((sentiment - {_sent_mean(30)}) / nullif(stddev_samp(sentiment) OVER {roll(30)}, 0), 0)", "sentiment_zscore"),
    R(f"avg(positive_news) OVER {roll(5)}", "positive_news_ratio"),
    R(f"avg(negative_news) OVER {roll(5)}", "negative_news_ratio"),
    R(f"avg(CASE WHEN sentiment < -0.2e0 THEN 1e0 ELSE 0e0 END) OVER {roll(5)}", "risk_mentions"),
    R(f"avg(CASE WHEN sentiment > 0.15e0 THEN 1e0 ELSE 0e0 END) OVER {roll(5)}", "revenue_mentions"),
    R(_sent_mean(5), "management_confidence"),
]


@query(
    "sentiment_windows",
    f"""WITH {BARS_CTE}, d AS (SELECT *, coalesce(sentiment - lag(sentiment) OVER w, 0) AS c {TAIL})
    SELECT symbol, "timestamp", {", ".join(_sent)} FROM d WINDOW w AS ({W})""",
)
def _(t):
    names = (
        "sentiment_1d sentiment_3d_mean sentiment_7d_mean sentiment_30d_mean sentiment_change "
        "sentiment_acceleration sentiment_zscore positive_news_ratio negative_news_ratio risk_mentions "
        "revenue_mentions management_confidence"
    )
    return shown(sentiment.sentiment_features(t.bars), names)


@query(
    "sentiment_sign_ratios",
    f"""WITH {TICKS_CTE} SELECT symbol, "timestamp", CASE WHEN sentiment > 0 THEN 1e0 ELSE 0e0 END AS positive_news_ratio,
    CASE WHEN sentiment < 0 THEN 1e0 ELSE 0e0 END AS negative_news_ratio FROM ticks""",
)
def _(t):
    """Without flag columns the ratios are the sign of the sentiment."""
    return shown(sentiment.sentiment_features(t.ticks), "positive_news_ratio negative_news_ratio")


@query(
    "sentiment_status",
    f"""WITH {TICKS_CTE}, l AS (SELECT symbol, arg_max(sentiment, "timestamp") AS s FROM ticks GROUP BY 1)
    SELECT symbol, {R("s", "composite_sentiment", 4)}, CASE WHEN s > 0.1e0 THEN 'BULLISH' WHEN s < -0.1e0 THEN 'BEARISH'
    ELSE 'NEUTRAL' END AS status FROM l""",
)
def _(t):
    return tidy(sentiment.sentiment_status(t.ticks), 4)


# Script tails give the Latin-only documents text in every script: one of nine
# word-list samples is appended by document number.
TAILS = [
    "", "राजस्व में वृद्धि", "घाटा और मंदी", "નફો અને વિકાસ", "જોખમ ઘટાડો", "মুনাফা বৃদ্ধি", "ঝুঁকি ক্ষতি", "लाभांश परिणाम",
    "तोटा कर्जबाजरी",
]


def texts(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("doc_id") % len(TAILS) + 1).cast("int"))
    return t["documents"].select("doc_id", F.concat_ws(" ", "text", tail).alias("headline"))


def _in(kind: str) -> str:
    return " + ".join(f"contains(h, '{w}')::INT" for w in LEXICON[kind])


TEXTS_CTE = f"""t AS (SELECT doc_id, text || ' ' || [{", ".join(f"'{x}'" for x in TAILS)}][doc_id % {len(TAILS)} + 1] AS h
  FROM documents)"""
SCRIPT_SQL = r"""CASE WHEN len(regexp_extract_all(h, '[\x{0900}-\x{097F}]')) > 2 THEN 'hi_mr'
  WHEN len(regexp_extract_all(h, '[\x{0A80}-\x{0AFF}]')) > 2 THEN 'gu'
  WHEN len(regexp_extract_all(h, '[\x{0980}-\x{09FF}]')) > 2 THEN 'bn' ELSE 'en' END"""


@query("script_detection", f"WITH {TEXTS_CTE} SELECT doc_id, {SCRIPT_SQL} AS language FROM t")
def _(t):
    return texts(t).select("doc_id", sentiment.script_of(F.col("headline")).alias("language"))


SENT_SQL = "coalesce((p - n)::DOUBLE / nullif(p + n, 0), 0)"


@query(
    "lexicon_sentiment",
    f"WITH {TEXTS_CTE}, c AS (SELECT doc_id, {_in('positive')} AS p, {_in('negative')} AS n FROM t)"
    f" SELECT doc_id, {R(SENT_SQL, 'sentiment')} FROM c",
)
def _(t):
    return tidy(texts(t).select("doc_id", sentiment.lexicon_sentiment(F.col("headline")).alias("sentiment")))


@query(
    "topic_flags",
    f"WITH {TEXTS_CTE} SELECT doc_id, "
    + ", ".join(f"(({_in(k)}) > 0)::INT::DOUBLE AS {k}" for k in ("risk", "revenue", "earnings"))
    + " FROM t",
)
def _(t):
    kinds = ("risk", "revenue", "earnings")
    return texts(t).select("doc_id", *[sentiment.mentions(F.col("headline"), k).alias(k) for k in kinds])


_templates = ", ".join(f"'{h}'" for h in HEADLINES)
NEWS_CTE = f"""dates AS (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS i
   FROM (SELECT DISTINCT "timestamp" FROM bars)),
 n0 AS (SELECT s.symbol, d."timestamp", replace([{_templates}][
     ('0x' || substr(md5('42|' || s.symbol || '|' || strftime(d."timestamp", '%Y-%m-%d')), 1, 8))::BIGINT % 8 + 1],
     '{{symbol}}', s.symbol) AS h FROM bars s JOIN dates d USING ("timestamp") WHERE d.i % 5 = 0),
 n1 AS (SELECT *, {_in('positive')} AS p, {_in('negative')} AS n FROM n0),
 news AS (SELECT symbol, "timestamp", h AS headline, {SENT_SQL} AS news_sentiment,
   (({_in('risk')}) > 0)::INT::DOUBLE AS indic_risk_signal, (({_in('revenue')}) > 0)::INT::DOUBLE AS revenue_mentions,
   {SCRIPT_SQL} AS language FROM n1)"""


@query(
    "synthetic_news",
    f"""WITH {BARS_CTE}, {NEWS_CTE} SELECT symbol, "timestamp", headline, {R("news_sentiment")}, indic_risk_signal,
    (news_sentiment > 0)::INT::DOUBLE AS positive_news, (news_sentiment < 0)::INT::DOUBLE AS negative_news,
    indic_risk_signal AS risk_mentions, revenue_mentions, {R("greatest(news_sentiment, 0)", "management_confidence")},
    language FROM news""",
)
def _(t):
    return tidy(synthetic.synthetic_news(t.bars))


@query(
    "news_join",
    f"""WITH {BARS_CTE}, {NEWS_CTE} SELECT symbol, "timestamp", {R("coalesce(news_sentiment, 0)", "news_sentiment")},
    headline FROM bars LEFT JOIN news USING (symbol, "timestamp")""",
)
def _(t):
    bars = t.bars
    return tidy(synthetic.attach_news(bars, synthetic.synthetic_news(bars)).select(*KEYS, "news_sentiment", "headline"))


_headline_rows = f"""x AS (SELECT symbol, "timestamp", coalesce(news_sentiment, 0) AS s, coalesce(indic_risk_signal, 0) AS r,
   CASE WHEN coalesce(language, 'en') <> 'en' THEN 1e0 ELSE 0e0 END AS m FROM bars LEFT JOIN news USING (symbol, "timestamp"))"""


@query(
    "headline_features",
    f"""WITH {BARS_CTE}, {NEWS_CTE}, {_headline_rows} SELECT symbol, "timestamp", {R("s", "indic_sentiment")},
    r AS indic_risk_signal, m AS indic_multilingual_flag, {R(f"avg(s) OVER {roll(7)}", "indic_sentiment_7d")},
    {R(f"avg(r) OVER {roll(7)}", "indic_risk_mentions_7d")} FROM x""",
)
def _(t):
    bars = t.bars
    df = synthetic.attach_news(bars, synthetic.synthetic_news(bars))
    names = (
        "indic_sentiment indic_risk_signal indic_multilingual_flag indic_sentiment_7d indic_risk_mentions_7d"
    )
    return shown(sentiment.headline_features(df), names)
