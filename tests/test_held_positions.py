"""Only names that get a weight are priced and shuffled; the weights are those of all rows."""

import datetime as dt
import random

from panelark.operators import backtest


def test_held_positions_are_the_weighted_rows(spark):
    rng = random.Random(5)
    rows = []
    for day in range(33):
        for s in range(40):
            if rng.random() < 0.9:
                tied = rng.choice([0.0, -0.0, 1.0]) if day % 2 else 0.0
                rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=day), f"S{s}", rng.choice([0.0, rng.uniform(1, 9)]), 1.0, rng.gauss(0, 1), tied, 2.0))
    names = [backtest.EQUAL_WEIGHT, "free", "tied", "still"]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, open double, " + ", ".join(f"{n} double" for n in names))
    signals = backtest.long_signals(df, names)
    usable = backtest.usable_rows(signals)
    dates = backtest.date_indices(usable)
    indexed = usable.join(dates, backtest.DATE_KEYS)
    shown = [*backtest.DATE_KEYS, "symbol", "date_idx", "fwd", "weight"]
    for hold, small in ((1, True), (3, False)):
        have = backtest.held_positions(indexed, dates, [backtest.EQUAL_WEIGHT, "still"], hold, 4, small).localCheckpoint()
        want = backtest.target_weights(backtest.rebalance_returns(indexed, hold), 4).where("weight > 0")
        assert sorted(map(str, have.where("weight > 0").select(shown).collect())) == sorted(map(str, want.select(shown).collect()))
        marks = have.where("weight = 0")
        assert marks.count() == dates.where(f"date_idx % {hold} = 0").count() == marks.where("symbol is null and fwd is null").count()
