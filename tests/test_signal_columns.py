"""Signals of rules and models in columns of one table."""

from pyspark.sql import functions as F

from panelark.operators import backtest
from panelark.plans import research


def test_unpredicted_rows_get_zero_and_rules_stay(spark, make_bars):
    df = make_bars(10).withColumns({"return_5d": F.col("sentiment"), "momentum_12_1": F.lit(0.5), "future_return_5d": F.lit(0.1)})
    scored = df.where("symbol = 'A'").withColumn("prediction", F.lit(2.0))
    table, names = research.signal_columns(df, {"prediction_full": scored})
    rows = backtest.long_signals(table, names)
    rules = backtest.rule_signals(df)
    kept = rows.where("strategy != 'prediction_full'")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rules.select(kept.columns).collect()))
    got = {(r.symbol, r.signal) for r in rows.where("strategy = 'prediction_full'").collect()}
    assert got == {("A", 2.0), ("B", 0.0), ("C", 0.0)} and rows.count() == 150
