"""Operators on small frames: edge rules, invariants and hand-computed values."""

import datetime as dt
import json
import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelark.functions.stats import newey_west
from panelark.operators import backtest, costs, cross_asset, drift, folds, ic, live, models, price, quality, rows
from panelark.operators import screening, selection, sentiment, weights
from panelark.sources import files, sinks, spec, synthetic

KEYS = ["symbol", "timestamp"]


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def pandas_of(df, *order):
    return df.orderBy(*order).toPandas()


# --- features ---------------------------------------------------------------------------


def test_price_features_match_pandas(make_bars):
    bars = make_bars(90, ("A", "B"))
    have = pandas_of(price.price_features(bars), *KEYS)
    raw = pandas_of(bars, *KEYS)
    for symbol, g in raw.groupby("symbol"):
        got = have[have.symbol == symbol].reset_index(drop=True)
        g = g.reset_index(drop=True)
        close = g["close"]
        move = close.diff()
        up = move.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        down = (-move.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        want = {
            "return_5d": close.pct_change(5).fillna(0),
            "std_20": close.pct_change().fillna(0).rolling(20, min_periods=2).std().fillna(0),
            "downside_volatility_20": close.pct_change().clip(upper=0).rolling(20, min_periods=2).std().fillna(0),
            "rsi_14": (100 - 100 / (1 + up / down)).fillna(50),
            "raw_macd": close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean(),
            "future_return_5d": g["open"].shift(-6) / g["open"].shift(-1) - 1,
            "obv": (np.sign(close.diff()).fillna(0) * g["volume"]).cumsum(),
        }
        for name, series in want.items():
            pd.testing.assert_series_equal(got[name], series, check_names=False, rtol=1e-9, atol=1e-12)


def test_macd_is_scale_free(make_bars, spark):
    bars = make_bars(60, ("A",))
    large = bars.withColumns({c: F.col(c) * 1000 for c in ("open", "high", "low", "close")}).withColumn("symbol", F.lit("B"))
    df = pandas_of(price.price_features(bars.unionByName(large), [price.add_macd]), *KEYS)
    a, b = df[df.symbol == "A"], df[df.symbol == "B"]
    np.testing.assert_allclose(a["macd_hist"], b["macd_hist"], rtol=1e-8, atol=1e-12)


def test_features_do_not_see_later_rows(make_bars):
    bars = make_bars(100, ("A", "B"))
    cut = F.lit(day(70)).cast("timestamp_ntz")
    whole = price.price_features(bars).where(F.col("timestamp") < cut)
    part = price.price_features(bars.where(F.col("timestamp") < cut))
    names = [c for c in selection.candidate_features(part)]
    a, b = pandas_of(whole, *KEYS), pandas_of(part, *KEYS)
    pd.testing.assert_frame_equal(a[names], b[names], rtol=1e-9)


def test_flat_prices_give_neutral_values(spark):
    flat = spark.createDataFrame(
        [(day(i), "A", 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(30)],
        "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double",
    )
    row = price.price_features(flat).where(F.col("timestamp") == F.lit(day(20)).cast("timestamp_ntz")).first()
    assert row["rsi_14"] == 50.0 and row["stoch_k"] == 50.0 and row["volume_change"] == 0.0 and row["volume_zscore"] == 0.0


def test_missing_prices_take_the_close(spark):
    df = spark.createDataFrame([(day(0), "A", 7.0)], "timestamp timestamp_ntz, symbol string, close double")
    row = price.with_ohlc(df).first()
    assert (row["open"], row["high"], row["low"]) == (7.0, 7.0, 7.0)


def test_beta_defaults_and_constant_benchmark(make_bars):
    bars = make_bars(30, ("A",)).withColumn("nifty_close", F.lit(100.0))
    df = pandas_of(cross_asset.cross_asset_features(bars), *KEYS)
    assert (df["rolling_beta"] == 1.0).all() and (df["correlation_to_market"] == 0.0).all()


def test_sectors_of_listed_and_unknown_names(spark):
    df = spark.createDataFrame([("TCS",), ("ZZZ",), ("M&M",)], "symbol string")
    got = {r["symbol"]: r["sector"] for r in cross_asset.tag_sectors(df).collect()}
    assert got == {"TCS": "IT", "ZZZ": "Other", "M&M": "Automobile"}


def test_scripts_and_lexicon(spark):
    texts = [
        ("कंपनी का मुनाफा और लाभ", "hi_mr", 1.0), ("નફો અને વિકાસ", "gu", 1.0), ("লাভ এবং বৃদ্ধি", "bn", 1.0),
        ("profit rises", "en", 0.0), ("   ", "en", 0.0), (None, "en", 0.0), ("मंदी", "hi_mr", -1.0),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in texts], "headline string")
    t = F.col("headline")
    got = df.select(sentiment.script_of(t).alias("s"), sentiment.lexicon_sentiment(t).alias("v")).collect()
    assert [(r["s"], r["v"]) for r in got] == [(s, v) for _, s, v in texts]


def test_an_entry_listed_twice_counts_twice(spark):
    from panelark.functions.text import entries_found

    df = spark.createDataFrame([("मंदी और लाभ",)], "h string")
    assert df.select(entries_found(F.col("h"), "negative")).first()[0] == 2


# --- quality and leakage -----------------------------------------------------------------


def test_quality_reasons(spark):
    rng = random.Random(1)
    data = [(day(i), "A", rng.random(), 1.0, None if i % 2 else 1.5 + i) for i in range(40)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, symbol string, x double, c double, m double")
    df = df.withColumns({"y": F.col("x"), "t": F.col("x") / 1e6})
    kept, reasons = quality.accepted_features(df, ["x", "y", "c", "m", "t"])
    assert kept == ["x"]
    assert reasons["y"] == "Duplicate feature vector"
    assert reasons["c"] == "Constant feature (zero variance)"
    assert reasons["m"] == "Excessive missing values (50.0%)"
    assert reasons["t"].startswith("Near-constant feature (variance")


def test_leakage_checks(spark):
    specs = spark.createDataFrame([("a", -1), ("future_x", 0), ("b", 3)], "name string, lag int")
    assert {r["name"] for r in quality.bad_lags(specs).collect()} == {"a", "future_x"}
    df = spark.createDataFrame([(1, 2, 3)], "future_return_5d int, future_other int, x int")
    assert quality.target_contamination(df) == ["future_other"]
    times = spark.createDataFrame([(1, 2), (3, 3)], "f int, t int")
    assert not quality.available_in_time(times, "f", "t").first()["available"]
    moved = spark.createDataFrame([("A", 0, 2), ("A", 1, 1), ("B", 0, 1), ("B", 1, 1)], "symbol string, n int, timestamp int")
    assert {r["symbol"]: r["ordered"] for r in quality.temporal_order(moved, "n").collect()} == {"A": False, "B": True}


def test_session_issues_name_the_problem(make_bars, spark):
    bars = make_bars(10, ("A", "B"))
    last = F.col("timestamp") == F.lit(day(9)).cast("timestamp_ntz")
    bad = bars.withColumn("volume", F.when(last & (F.col("symbol") == "A"), 0.0).otherwise(F.col("volume")))
    bad = bad.withColumn("close", F.when(last & (F.col("symbol") == "B"), F.lit(float("inf"))).otherwise(F.col("close")))
    row = quality.session_issues(bad).first()
    assert not row["valid"] and any(r.startswith("volume") for r in row["reasons"])
    assert any(r.startswith("close: 1") for r in row["reasons"])
    assert quality.session_issues(bars).first()["valid"]
    wanted = spark.createDataFrame([(s,) for s in "ABCD"], "symbol string")
    assert any(r.startswith("universe") for r in quality.session_issues(bars, wanted).first()["reasons"])


# --- inference ------------------------------------------------------------------------------


def hac(x, lags=5):
    e = x - x.mean()
    v = np.mean(e * e) + sum(2 * (1 - k / (lags + 1)) * np.mean(e[k:] * e[:-k]) for k in range(1, lags + 1))
    return math.sqrt(max(v, 1e-8) / len(x))


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.convolve(rng.normal(size=260), [1, 0.5, 0.25], "same")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "timestamp int, ic double")
    row = newey_west(df, "ic", "timestamp").first()
    assert row["nw_se"] == pytest.approx(hac(x), rel=1e-9)
    flat = spark.createDataFrame([(i, 0.5) for i in range(5)], "timestamp int, ic double")
    assert newey_west(flat, "ic", "timestamp").first()["t_stat"] == 0.0


def panel(spark, strength, seed=0, dates=60, names=25):
    rng = np.random.default_rng(seed)
    data = []
    for d in range(dates):
        for s in range(names):
            x, noise = rng.normal(), rng.normal()
            data.append((day(d), f"N{s:02d}", float(x), float(rng.normal()), float(strength * x + noise)))
    return spark.createDataFrame(data, "timestamp timestamp_ntz, symbol string, good double, noise double, future_return_5d double")


def test_planted_signal_is_found_and_noise_is_not(spark):
    df = panel(spark, 0.3)
    table = {r["feature"]: r for r in selection.evaluate_features(df, ["good", "noise"]).collect()}
    assert table["good"]["mean_ic"] > 0.2 and table["good"]["ic_tstat"] > 5
    assert abs(table["noise"]["ic_tstat"]) < 3.5
    assert table["good"]["score"] > table["noise"]["score"]
    assert selection.select_features(df, ["noise", "good"], top_k=1) == ["good"]


def test_small_or_constant_dates_have_no_ic(spark):
    data = [(day(0), 1.0, 1.0), (day(0), 2.0, 2.0), (day(1), 1.0, 1.0), (day(1), 1.0, 2.0), (day(1), 1.0, 3.0)]
    data += [(day(2), float(i), float(i * i)) for i in range(4)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, p double, future_return_5d double")
    got = ic.daily_rank_ic(df, "p").collect()
    assert [(r["timestamp"], r["ic"]) for r in got] == [(day(2), 1.0)]


def test_fold_geometry(make_bars):
    dates = folds.fold_dates(make_bars(70, ("A",)), splits=6).toPandas()
    for _, part in dates.groupby("fold"):
        train, test = part[part.role == "train"], part[part.role == "test"]
        assert test.date_idx.min() - train.date_idx.max() > 6
    # asking for a shorter embargo does not go below the minimum
    short = folds.fold_dates(make_bars(70, ("A",)), splits=6, embargo=1).toPandas()
    assert (short.sort_values(["fold", "role", "date_idx"]).date_idx.to_numpy() ==
            dates.sort_values(["fold", "role", "date_idx"]).date_idx.to_numpy()).all()


def test_even_split_matches_numpy(spark):
    for total, parts in ((11, 4), (60, 6), (7, 7), (5, 2)):
        df = spark.range(total).select(folds.split_place(F.col("id"), F.lit(total), parts).alias("p"))
        want = [i for i, c in enumerate(np.array_split(np.arange(total), parts)) for _ in c]
        assert [r["p"] for r in df.collect()] == want


# --- backtest --------------------------------------------------------------------------------


def test_drifted_equal_weight_turnover(spark):
    data = []
    for i in range(20):
        data.append((day(i), "A", 100.0 * 1.02**i, 1.0))
        data.append((day(i), "B", 100.0, 1.0))
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, symbol string, open double, eq_weight_signal double")
    periods = backtest.panel_periods(backtest.long_signals(df, ["eq_weight_signal"])).orderBy("period").collect()
    growth = 1.02**5
    drifted = growth / (growth + 1)
    assert periods[0]["turnover"] == pytest.approx(1.0)
    assert periods[1]["turnover"] == pytest.approx(2 * abs(0.5 - drifted))
    assert periods[0]["gross"] == pytest.approx((growth - 1) / 2)


def test_deflated_sharpe_formula(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.004, 0.02, 80)
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(r)], "strategy string, timestamp timestamp_ntz, net double")
    row = backtest.deflated_sharpe(backtest.performance(df)).first()
    m, sd = r.mean(), r.std(ddof=1)
    z = (r - m) / r.std()
    sr, sk, ku = m / sd, np.mean(z**3), np.mean(z**4)
    se = math.sqrt((1 - sk * sr + (ku - 1) / 4 * sr**2) / (len(r) - 1))
    n, g, scale = NormalDist(), backtest.EULER_GAMMA, math.sqrt(252 / 5)
    best = 0.2 * ((1 - g) * n.inv_cdf(1 - 1 / 41) + g * n.inv_cdf(1 - 1 / (41 * math.e)))
    assert row["dsr_41"] == pytest.approx(n.cdf((sr * scale - best) / (se * scale + 1e-8)), abs=1e-9)
    assert row["dsr_41"] > row["dsr_100"] > row["dsr_200"]


def test_return_series_align_by_date_or_place(spark):
    a = spark.createDataFrame([(day(i * 5), float(i)) for i in range(20)], "timestamp timestamp_ntz, net double")
    b = spark.createDataFrame([(day(i * 5 + 50), float(i)) for i in range(15)], "timestamp timestamp_ntz, net double")
    assert backtest.align_returns(a, b).orderBy("pos").first()["a"] == 10.0
    c = b.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    placed = backtest.align_returns(a, c).orderBy("pos").collect()
    assert len(placed) == 15 and placed[0]["a"] == 0.0


def test_statutory_round_trip(spark):
    assert costs.flat_round_trip_bps() == pytest.approx(27.22, abs=0.01)
    df = spark.createDataFrame([(100000.0, "delivery"), (-5.0, "delivery")], "notional double, trade_type string")
    row = costs.round_trip_bps(df.where("notional > 0")).first()
    assert row["one_way_bps"] == pytest.approx(costs.flat_round_trip_bps() / 2)
    zero = df.where("notional < 0").select(costs.trade_cost(F.col("notional"), F.lit("buy"))).first()[0]
    assert zero == 0.0


def test_weights_cap_hysteresis_and_truncation(spark):
    book = [("b", f"N{i}", float(10 - i)) for i in range(10)]
    df = spark.createDataFrame(book, "book string, symbol string, prediction double")
    plain = {r["symbol"]: r["weight"] for r in weights.cash_weights(df, ["book"], max_weight=0.05).collect()}
    assert {s for s, w in plain.items() if w > 0} == {"N0", "N1"} and plain["N0"] == 0.05
    held = spark.createDataFrame([("N2",), ("N9",)], "symbol string")
    kept = weights.cash_weights(df, ["book"], held=held).where("weight > 0").collect()
    # N2 ranks in the buffer, but only two names fit and they go by name
    assert {r["symbol"] for r in kept} == {"N0", "N1"}


# --- position keeping --------------------------------------------------------------------------


def test_small_targets_keep_the_quantity(spark):
    equity = spark.createDataFrame([("p", 100000.0)], "portfolio string, equity double")
    positions = spark.createDataFrame([("p", "A", 10.0), ("p", "B", 5.0)], "portfolio string, symbol string, qty double")
    targets = spark.createDataFrame([("p", "A", 0.01), ("p", "C", 0.5)], "portfolio string, symbol string, weight double")
    bars = spark.createDataFrame(
        [("A", 100.0, 1e7), ("B", 50.0, 1e7), ("C", 30.0, None)], "symbol string, open double, adv_20d double"
    )
    orders = {r["symbol"]: r["delta"] for r in live.rebalance_orders(equity, positions, targets, bars).collect()}
    assert orders == {"B": -5.0, "C": 1666.0}
    fills = live.fill_orders(live.rebalance_orders(equity, positions, targets, bars))
    c = fills.where("symbol = 'C'").first()
    assert c["fill_price"] == pytest.approx(30 * (1 + (5 + 10 * math.sqrt(49980 / 1e7)) / 1e4))


def test_pause_is_sticky(spark):
    data = [("p", day(i), e) for i, e in enumerate([100.0, 120.0, 107.0, 119.0, 130.0])]
    df = spark.createDataFrame(data, "portfolio string, timestamp timestamp_ntz, equity double")
    got = live.kill_switch(df).orderBy("timestamp").collect()
    assert [r["paused"] for r in got] == [False, False, True, True, True]


def test_tampered_log_is_found(spark):
    data = [("p", day(d), s, 0.5, 0.05) for d in range(3) for s in ("A", "B")]
    signals = spark.createDataFrame(
        data, "portfolio string, signal_date timestamp_ntz, symbol string, prediction double, weight double"
    )
    log = live.chain_log(live.log_digests(signals))
    assert all(r["valid"] for r in live.verify_chain(log).collect())
    second = F.col("signal_date") == F.lit(day(1)).cast("timestamp_ntz")
    broken = log.withColumn("digest", F.when(second, F.lit("0")).otherwise(F.col("digest")))
    assert [r["valid"] for r in live.verify_chain(broken).orderBy("signal_date").collect()] == [True, False, True]


def test_ledger_round_trip(spark):
    accounts = spark.createDataFrame([("p", 1000.0), ("q", 5.0)], "portfolio string, cash double")
    positions = spark.createDataFrame(
        [("p", " tcs ", 3.0, 10.0), ("p", "CASH", 1.0, 1.0), ("p", "X", 0.0, 4.0)],
        "portfolio string, symbol string, qty double, avg_price double",
    )
    documents = live.ledger_documents(accounts, positions)
    stored = json.loads(documents.where("portfolio = 'p'").first()["ledger"])
    assert stored["positions"] == {"TCS": {"qty": 3.0, "avg_price": 10.0}}
    got = {(r["portfolio"], r["symbol"]): r["notional"] for r in live.ledger_rows(documents).collect()}
    assert got == {("p", "TCS"): 30.0, ("q", "CASH"): 5.0}


def test_trading_calendar(spark):
    days = spark.createDataFrame(
        [(dt.datetime(2024, 1, d),) for d in (19, 20, 22, 23, 26)], "timestamp timestamp_ntz"
    )
    assert [r["timestamp"].day for r in rows.trading_days(days).orderBy("timestamp").collect()] == [19, 23]


@pytest.mark.parametrize(
    ("price_", "stop", "age", "high", "loss", "want"),
    [
        (100.0, 97.0, 0, False, 0.0, "APPROVE"),
        (100.0, 97.0, 0, False, 2.5, "REJECT"),
        (20.0, 19.0, 0, False, 0.0, "REJECT"),
        (100.0, 97.0, 5, False, 0.0, "REJECT"),
        (100.0, 97.0, 0, True, 0.0, "REJECT"),
        (100.0, 70.0, 0, False, 0.0, "REDUCE"),
    ],
)
def test_gates(spark, price_, stop, age, high, loss, want):
    df = spark.createDataFrame(
        [("A", price_, price_, stop, age, high)],
        "symbol string, price double, entry double, stop double, data_age_days int, high_drift boolean",
    )
    assert screening.risk_gate(df, loss_today_pct=loss).first()["verdict"] == want


# --- drift ----------------------------------------------------------------------------------------


def test_drift_flags_shift_and_not_noise(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(600, 2))], "x double, y double")
    cur = spark.createDataFrame([(float(a), float(b) + 2) for a, b in rng.normal(size=(600, 2))], "x double, y double")
    table = {r["feature"]: r for r in drift.drift_table(ref, cur).collect()}
    assert table["y"]["status"] == "HIGH" and table["y"]["psi"] > 0.25 and table["x"]["psi"] < 0.1
    assert drift.drift_gate(ref, cur.limit(20), ["x", "y"]).first()["status"] == "SKIP"
    assert drift.drift_gate(ref, cur, ["x", "y"], min_breaches=1).first()["status"] == "HIGH"


def test_psi_of_a_constant_reference(spark):
    ref = spark.createDataFrame([(1.0,)] * 10, "x double")
    cur = spark.createDataFrame([(0.0,)] * 5 + [(2.0,)] * 5, "x double")
    got = drift.population_stability(drift.stacked(ref, cur, ["x"])).first()["psi"]
    want = (0.5 - 1e-6) * math.log(0.5 / 1e-6) + (0.5 - 1.0) * math.log(0.5)
    assert got == pytest.approx(want)


# --- files -------------------------------------------------------------------------------------------


def test_vendor_files(spark, tmp_path):
    (tmp_path / "hdfc-bank.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,100\n2024-01-02,x,2,1,NaN,\n")
    (tmp_path / "b.csv").write_text('Ticker,Trade Date,Last,News Sentiment\n"TCS",2024-01-01,9,0.25\n')
    got = {(r["symbol"], r["timestamp"].day): r for r in files.read_bars(spark, str(tmp_path)).collect()}
    assert set(got) == {("HDFC_BANK", 1), ("HDFC_BANK", 2), ("TCS", 1)}
    assert got["HDFC_BANK", 2]["open"] is None and got["HDFC_BANK", 2]["close"] is None
    assert got["HDFC_BANK", 1]["sentiment"] == 0.0 and got["TCS", 1]["sentiment"] == 0.25 and got["TCS", 1]["close"] == 9.0
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        files.read_bars(spark, str(tmp_path / "empty"))


def test_news_and_benchmark_files(spark, tmp_path):
    news = tmp_path / "news" / "deep"
    news.mkdir(parents=True)
    (news / "a.json").write_text(json.dumps([{"published_at": "2024-01-01", "company": "tcs", "article": "t1"}]))
    (news / "b.csv").write_text("Date,Ticker,Text,Sentiment\n2024-01-02,infy,t2,0.5\n")
    got = {r["symbol"]: r for r in files.read_news(spark, [str(tmp_path / "news"), str(tmp_path / "none")]).collect()}
    assert got["TCS"]["headline"] == "t1" and got["TCS"]["news_sentiment"] == 0.0 and got["INFY"]["news_sentiment"] == 0.5
    bench = tmp_path / "bench.csv"
    bench.write_text("Date,Last,Volume\n2024-01-01,10,1\n2024-01-01,11,2\n2024-01-02,12,3\n")
    series = files.read_benchmark(spark, str(bench), "NIFTY").orderBy("timestamp").collect()
    assert [(r["nifty_close"], r["nifty_volume"]) for r in series] == [(10.0, 1.0), (12.0, 3.0)]


def test_signal_sink_replaces_only_its_dates(spark, tmp_path):
    def day_rows(d, v):
        return spark.createDataFrame([(day(d), "A", v)], "signal_date timestamp_ntz, symbol string, prediction double")

    folder = str(tmp_path / "signals")
    for d, v in ((0, 1.0), (1, 2.0), (1, 3.0)):
        sinks.write_signals(day_rows(d, v), folder)
    stored = spark.read.parquet(folder)
    assert stored.count() == 2
    assert [r["prediction"] for r in sinks.latest_signals(spark, folder).collect()] == [3.0]


def test_specs(tmp_path):
    path = tmp_path / "f.yaml"
    path.write_text("features:\n  - {name: a, category: c, lag: 1}\n  - {category: none}\n")
    assert [s["name"] for s in spec.read_specs(str(path))] == ["a"]
    assert spec.filter_names(spec.declared_specs(), ["rsi_14", "nothing"]) == ["rsi_14"]


def test_synthetic_bars(spark):
    got = synthetic.synthetic_bars(spark, 10, ("A",)).orderBy("timestamp").collect()
    close, volume = 100.0, 1000
    for i, row in enumerate(got):
        close *= 1 + 0.0008 + 0.002 * ((i % 7) - 3) / 3
        volume = int(volume * (1 + 0.02 * ((i % 5) - 2)))
        assert row["close"] == pytest.approx(close, abs=1e-4) and row["volume"] == volume


# --- models -------------------------------------------------------------------------------------------


def test_walk_forward_learns_a_planted_signal(spark):
    df = panel(spark, 1.0, dates=40, names=15)
    out = models.walk_forward(df, ["good", "noise"], factory=lambda: models.forest(10, 4), splits=3)
    assert out.select("fold").distinct().count() == 2
    assert ic.daily_rank_ic(out, "prediction").agg(F.avg("ic")).first()[0] > 0.4
    with pytest.raises(ValueError):
        models.predict(None, df, ["absent"])


def test_pruning_keeps_the_better_of_two_copies(spark):
    df = panel(spark, 0.3).withColumn("copy", F.col("good") * 3)
    assert selection.prune_redundant(df, ["good", "copy", "noise"]) == ["good", "noise"]


def test_ewm_keeps_its_value_over_long_gaps(spark):
    from panelark.functions.windows import ewm

    stamps = [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(9000)]
    x = [100.0] * 5 + [None] * 3000 + [50.0, 40.0] + [None] * 40 + [60.0] + [None] * 8000
    x = (x + [float(i % 7) for i in range(9000)])[:3060] + [float(i % 7) for i in range(9000 - 3060)]
    df = spark.createDataFrame([(t, "A", v) for t, v in zip(stamps, x)], "timestamp timestamp_ntz, symbol string, x double")
    got = ewm(df, "x", 0.1, "y").orderBy("timestamp").toPandas()["y"]
    want = pd.Series(x, dtype=float).ewm(alpha=0.1, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-9)


def test_a_file_without_a_header_fails_and_wide_files_are_read(spark, tmp_path):
    from panelark.sources import files

    (tmp_path / "a.csv").write_text(",".join([f"f{i}" for i in range(70)]) + ",Date,Close\n" + ",".join("x" * 70) + ",2024-01-02,5\n")
    rows = files.read_bars(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.close) for r in rows] == [("A", 5.0)]
    (tmp_path / "b.csv").write_text("when,Close\n2024-01-02,5\n")
    with pytest.raises(Exception, match="no header line naming timestamp, close in .*b.csv"):
        files.read_bars(spark, str(tmp_path)).collect()


def test_quality_marks_count_repeated_keys(spark):
    from panelark.operators.quality import quality_gate

    rng = np.random.default_rng(1)
    rows = [(dt.datetime(2024, 1, 1 + i % 28), f"S{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame(rows * 2, "timestamp timestamp_ntz, symbol string, a double, b double")
    assert [r.reason for r in quality_gate(df, ["a", "b"]).collect()] == [None, None]
    again = quality_gate(df.withColumn("c", df.a), ["a", "b", "c"]).orderBy("place").collect()
    assert [r.reason for r in again] == [None, None, "Duplicate feature vector"]
