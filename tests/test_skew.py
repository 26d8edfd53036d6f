"""The split paths for hot groups must give what the plain paths give."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelark.functions.ranks import average_rank, running_counts
from panelark.functions.skew import balanced, dealt, input_bytes, split_hot
from panelark.functions.stats import bootstrap_mean_ci, newey_west
from panelark.functions.windows import ewm, fill_gaps, over_series, per_group, running
from panelark.operators import backtest, drift, live, price
from panelark.operators.weights import cash_weights
from panelark.plans import research

SETTINGS = {
    "spark.panelark.skew.smallInputBytes": "0",
    "spark.panelark.skew.minRows": "60",
    "spark.panelark.skew.sliceRows": "100",
}


def both_ways(spark, build, keys, digits=9):
    """Rows of ``build`` on the plain path and on the split path."""
    out = []
    for split in (False, True):
        for key, value in SETTINGS.items():
            (spark.conf.set(key, value) if split else spark.conf.unset(key))
        try:
            out.append(build().toPandas().sort_values(keys).reset_index(drop=True))
        finally:
            for key in SETTINGS:
                spark.conf.unset(key)
    plain, hot = out
    assert len(plain) == len(hot)
    pd.testing.assert_frame_equal(plain, hot[plain.columns], rtol=10**-digits, atol=10**-digits, check_dtype=False)
    return plain


@pytest.fixture
def skewed(spark):
    """One symbol with 600 rows among nine with 12, prices with gaps."""
    rng = random.Random(3)
    rows = []
    for s in range(10):
        for i in range(600 if s == 0 else 12):
            close = 100 + rng.gauss(0, 5)
            rows.append(
                (
                    f"S{s}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i * (1 + s)), close * 0.99, close * 1.02,
                    close * 0.97, close, float(rng.randint(1, 99)), rng.choice([None, rng.random()]), float(rng.randint(0, 3)),
                )
            )
    return spark.createDataFrame(
        rows,
        "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double,"
        " gap double, tied double",
    ).repartition(5)


KEYS = ["symbol", "timestamp"]


def test_small_input_is_never_split(spark, skewed):
    assert split_hot(skewed, ["symbol"], "timestamp") is None


def test_checked_keys_are_not_counted_again(hot, skewed):
    with balanced(["symbol"]):
        assert split_hot(skewed, ["symbol"], "timestamp") is None
    assert split_hot(skewed, ["symbol"], "timestamp") is not None


def test_drift_with_hot_features(spark, skewed):
    cut = F.col("timestamp") < F.lit(dt.datetime(2020, 1, 10)).cast("timestamp_ntz")
    names = ["close", "tied", "gap"]
    both_ways(spark, lambda: drift.drift_table(skewed.where(cut), skewed.where(~cut), names), ["feature"])


def test_hot_group_is_found_and_counted(hot, skewed):
    split = split_hot(skewed, ["symbol"], "timestamp")
    assert {r["symbol"] for r in split.table.collect()} == {"S0"}
    placed = split.attach(skewed).where("symbol = 'S0'")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.max("_in_range").alias("m")).collect()
    assert len(sizes) > 8 and all(r["n"] == r["m"] for r in sizes)
    assert sum(r["n"] for r in sizes) == 600


def test_price_features(spark, skewed):
    frame = both_ways(spark, lambda: price.price_features(skewed), KEYS, digits=7)
    assert len(frame) == 708


def test_ewm_with_gaps(spark, skewed):
    frame = both_ways(spark, lambda: ewm(skewed, "gap", 0.3, "y", least=5).select(*KEYS, "y"), KEYS)
    # the same numbers as pandas
    raw = skewed.toPandas().sort_values(KEYS)
    for symbol, part in raw.groupby("symbol"):
        want = part["gap"].astype(float).ewm(alpha=0.3, adjust=False, min_periods=5).mean().to_numpy()
        have = frame[frame.symbol == symbol]["y"].to_numpy()
        pd.testing.assert_series_equal(pd.Series(have), pd.Series(want), rtol=1e-9)


@pytest.mark.parametrize(
    ("alpha", "seen"), [(0.1, "first five"), (0.1, "two far apart"), (2 / 27, "rare"), (0.5, "late"), (0.3, "none")]
)
def test_means_are_carried_over_ranges_without_observations(spark, alpha, seen):
    rng = random.Random(11)
    n = 3000

    def there(i):
        return {
            "first five": i < 5, "two far apart": i in (3, 2900), "rare": i % 611 == 2, "late": i >= 2950, "none": False,
        }[seen]

    rows = [("H", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), 50 + rng.gauss(0, 9) if there(i) else None) for i in range(n)]
    rows += [(f"C{i}", dt.datetime(2020, 1, 1), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, x double")
    frame = both_ways(spark, lambda: ewm(df, "x", alpha, "y", least=2), KEYS)
    hot = frame[frame.symbol == "H"].sort_values("timestamp")
    want = pd.Series([r[2] for r in rows[:n]], dtype=float).ewm(alpha=alpha, adjust=False, min_periods=2).mean()
    pd.testing.assert_series_equal(pd.Series(hot["y"].to_numpy()), want, rtol=1e-9)


def test_means_of_means_are_carried(spark, skewed):
    frame = both_ways(spark, lambda: price.add_macd(skewed).select(*KEYS, "raw_macd", "macd_signal"), KEYS)
    close = skewed.where("symbol = 'S0'").toPandas().sort_values("timestamp")["close"].reset_index(drop=True)
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    have = frame[frame.symbol == "S0"].sort_values("timestamp")
    assert abs(have["raw_macd"].to_numpy() - line.to_numpy()).max() < 1e-9
    assert abs(have["macd_signal"].to_numpy() - (line.ewm(span=9, adjust=False).mean() / close).to_numpy()).max() < 1e-9


@pytest.mark.parametrize("how", ["sum", "max", "product"])
def test_running(spark, skewed, how):
    value = F.col("close") / 100
    both_ways(spark, lambda: running(skewed, {"t": value}, how=how).select(*KEYS, "t"), KEYS)


def test_fill_gaps(spark, skewed):
    sparse = skewed.withColumn("gap", F.when(F.col("gap") > 0.97, F.col("gap")))
    both_ways(spark, lambda: fill_gaps(sparse, "gap").select(*KEYS, "gap"), KEYS)


def test_per_group(spark, skewed):
    both_ways(spark, lambda: per_group(skewed, ["symbol"], {"m": F.avg("close")}).select(*KEYS, "m"), KEYS)


@pytest.mark.parametrize(
    ("column", "descending", "ties"),
    [("close", False, "average"), ("tied", True, "average"), ("tied", True, "min"), ("tied", False, "min")],
)
def test_ranks(spark, skewed, column, descending, ties):
    def build():
        return average_rank(skewed, column, "r", ["symbol"], descending, ties).select(*KEYS, "r")

    frame = both_ways(spark, build, KEYS)
    raw = skewed.toPandas()
    raw["want"] = raw.groupby("symbol")[column].rank(ascending=not descending, method=ties)
    merged = frame.merge(raw, on=KEYS)
    assert (merged["r"] == merged["want"]).all()


def test_whole_table_rank_and_counts(spark, skewed):
    both_ways(spark, lambda: average_rank(skewed, "tied", "r").select(*KEYS, "r"), KEYS)
    both_ways(spark, lambda: running_counts(skewed, "close", {"n": F.lit(1)}), ["close"])


def test_string_order_in_a_hot_group(spark):
    names = [(f"N{random.Random(i).randint(0, 10**9):010d}", 1) for i in range(400)]
    df = spark.createDataFrame(names, "symbol string, g int")
    frame = both_ways(spark, lambda: average_rank(df, "symbol", "r", ["g"]), ["symbol"])
    assert list(frame["r"]) == list(range(1, len(names) + 1))


def test_newey_west_and_bootstrap(spark):
    rng = random.Random(5)
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), rng.gauss(0.1, 1)) for i in range(300)]
    series = spark.createDataFrame(rows, "timestamp timestamp_ntz, ic double")
    both_ways(spark, lambda: newey_west(series, "ic", "timestamp"), ["n"])
    both_ways(spark, lambda: bootstrap_mean_ci(series, "ic", "timestamp", draws=50), ["ci_low"])


def test_backtest_on_a_hot_symbol(spark, skewed):
    df = skewed.withColumns({"return_5d": F.col("tied") - 1.5 + F.col("close") / 1000})
    signals = backtest.rule_signals(df.withColumn("momentum_12_1", F.col("close") - 100))
    both_ways(spark, lambda: backtest.panel_periods(signals, hold=3, top_k=4), ["strategy", "timestamp"])


def test_weights_in_one_large_book(spark, skewed):
    book = skewed.where("symbol = 'S0'").select(
        F.lit(1).alias("book"), F.date_format("timestamp", "yyyyMMddHH").alias("symbol"), F.col("tied").alias("prediction")
    )
    frame = both_ways(spark, lambda: cash_weights(book, ["book"], max_names=7), ["symbol"])
    assert (frame["weight"] > 0).sum() == 7


def test_signal_digests_do_not_depend_on_the_path(spark, skewed):
    log = skewed.select(
        F.lit("p").alias("portfolio"), F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("signal_date"),
        F.concat("symbol", F.date_format("timestamp", "yyyyMMddHH")).alias("symbol"),
        F.col("close").alias("prediction"), F.col("tied").alias("weight"),
    )
    both_ways(spark, lambda: live.log_digests(log, leaf=50), ["portfolio"])


def test_feature_matrix_is_dealt_by_input_size(spark, make_bars, tmp_path):
    """Partitions of the wide rows grow with the input, whatever the packed size of the shuffle."""
    make_bars(120, [f"S{i}" for i in range(40)]).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    spark.conf.set("spark.panelark.dealtBytes", "10000")
    try:
        wanted = -(-input_bytes(bars) // 10000)
        assert wanted > 8 and dealt(bars, ["symbol"]).rdd.getNumPartitions() == wanted
        plan = research.feature_matrix(bars)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.panelark.dealtBytes")
    assert re.search(rf"RepartitionByExpression \[symbol#\d+\], {wanted}\n", plan)


def test_feature_matrix_is_not_dealt_with_a_hot_symbol(hot, make_bars):
    plan = research.feature_matrix(make_bars(120, ["A"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
