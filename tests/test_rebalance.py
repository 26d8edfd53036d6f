"""Returns of rebalance dates from two dates in ``hold``, and signals that are stored once."""

import datetime as dt
import random

import pytest

from panelark.operators import backtest


def signals(spark, days=40):
    rng = random.Random(5)
    rows = [
        (s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), n, rng.choice([0.0, 1.0, 2.0, 3.0]), rng.gauss(0, 1))
        for s in ("a", "b")
        for d in range(days)
        for n in "KLMNO"
        if rng.random() < 0.8
    ]
    return spark.createDataFrame(rows, "strategy string, timestamp timestamp_ntz, symbol string, open double, signal double")


@pytest.mark.parametrize("hold", [1, 2, 5])
def test_rebalance_dates_have_the_returns_of_all_rows(spark, hold):
    rows = backtest.with_date_index(signals(spark)).localCheckpoint()
    want = backtest.forward_returns(rows, hold).where(f"date_idx % {hold} = 0")
    got = backtest.rebalance_returns(rows, hold)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("fwd is not null").count() > 10


def test_stored_signals_are_not_written_again(spark, monkeypatch):
    labels = []
    write = backtest.written
    monkeypatch.setattr(backtest, "written", lambda df, label: (labels.append(label), write(df, label))[1])
    frame = signals(spark)
    once = sorted(map(str, backtest.panel_periods(frame, top_k=2, stored=True).collect()))
    assert labels == ["strategy-dates", "periods"]
    assert once == sorted(map(str, backtest.panel_periods(frame, top_k=2).collect()))


def test_split_dates_give_the_same_periods(spark, request):
    frame = signals(spark)
    whole = backtest.panel_periods(frame, top_k=2, stored=True).orderBy("strategy", "period").collect()
    request.getfixturevalue("hot")
    parts = backtest.panel_periods(frame, top_k=2, stored=True).orderBy("strategy", "period").collect()
    assert len(whole) == len(parts) == 16
    assert all(a[:3] == b[:3] and abs(a.gross - b.gross) < 1e-9 and abs(a.turnover - b.turnover) < 1e-9 for a, b in zip(whole, parts))
