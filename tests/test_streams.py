"""Stateful streams over several micro-batches, and what they see of earlier ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelark.operators import quality
from panelark.streaming import jobs


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


def arrive(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def plain(batches, alpha=0.1, limit=0.1):
    """Row by row: what every symbol's rows give, late ones left aside."""
    state, out = {}, {}
    for rows in batches:
        before = {s: v[3] for s, v in state.items()}
        for s, t, v in sorted(rows, key=lambda r: r[1]):
            if s in before and t <= before[s]:
                out[s, t] = None
                continue
            mean, peak, paused, _ = state.get(s, (v, v, False, None))
            mean, peak = (1 - alpha) * mean + alpha * v, max(peak, v)
            fall = v / peak - 1 if peak else 0.0
            paused = paused or fall <= -limit
            state[s] = (mean, peak, paused, t)
            out[s, t] = (mean, peak, fall, paused)
    return out


BATCHES = [
    [("a", at(1), 100.0), ("a", at(2), 105.0), ("b", at(1), 7.0)],
    [("a", at(1.5), 50.0), ("a", at(4), 80.0), ("a", at(3), 104.0), ("c", at(0), 0.0)],
    [("a", at(4), 1.0), ("a", at(5), 200.0), ("b", at(0.5), 9.0), ("b", at(9), 8.0), ("c", at(1), 5.0)],
]


def test_state_is_kept_across_batches_and_late_rows_are_told(spark, tmp_path):
    stream = arrive(spark, str(tmp_path / "in"), BATCHES, "symbol string, timestamp timestamp, value double")
    jobs.run_to_table(jobs.running_state(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == sum(map(len, BATCHES))
    want = plain(BATCHES)
    for r in rows:
        expected = want[r.symbol, r.timestamp] if not (r.symbol == "a" and r.timestamp == at(4)) else "twice"
        if expected == "twice":  # once on time and once late
            assert r.late == (r.value == 1.0)
        elif expected is None:
            assert r.late and r.ewm is None and r.paused is None
        else:
            assert not r.late and (r.ewm, r.peak, r.drawdown) == pytest.approx(expected[:3]) and r.paused == expected[3]
    assert sum(r.late for r in rows) == 3


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    schema = "symbol string, timestamp timestamp, value double"
    for k in range(3):
        stream = arrive(spark, str(tmp_path / "in"), BATCHES[k : k + 1], schema)
        jobs.run_to_table(jobs.running_state(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == sum(map(len, BATCHES)) and rows.where("late").count() == 3
    assert rows.where("symbol = 'a' AND value = 200").first().paused


def test_live_bars_show_open_windows_and_replace_older_versions(spark, tmp_path):
    def tick(s, minute, value):
        return (s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), value)

    batches = [
        [tick("a", 5, 10.0), tick("a", 30, 12.0), tick("b", 10, 1.0)],
        [tick("a", 50, 9.0), tick("a", 70, 8.0)],
        [tick("a", 400, 7.0)],
        [tick("b", 410, 2.0)],
        [tick("a", 20, 99.0)],  # late: Spark judges it by the ticks up to two batches before
    ]
    stream = arrive(spark, str(tmp_path / "in"), batches, "symbol string, ts timestamp, value double")
    jobs.live_bars(jobs.tick_bars(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = {(r.symbol, r.timestamp.hour): r for r in jobs.newest_bars(spark, str(tmp_path / "out")).collect()}
    assert {k: (r.open, r.high, r.low, r.close, r.volume, r.versions, r.final) for k, r in rows.items()} == {
        ("a", 0): (10.0, 12.0, 9.0, 9.0, 3.0, 2, True),
        ("b", 0): (1.0, 1.0, 1.0, 1.0, 1.0, 1, True),
        ("a", 1): (8.0, 8.0, 8.0, 8.0, 1.0, 1, True),
        ("a", 6): (7.0, 7.0, 7.0, 7.0, 1.0, 1, False),
        ("b", 6): (2.0, 2.0, 2.0, 2.0, 1.0, 1, False),
    }


BAR = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, sentiment double"


def bar(s, i, close, volume=10.0):
    return (s, at(i), close, close, close, close, volume, 0.0)


def test_monitor_sees_a_gap_between_batches(spark, tmp_path):
    batches = [[bar("a", 1, 100.0), bar("b", 1, 50.0)], [bar("a", 2, 100.0), bar("b", 2, 80.0)], [bar("b", 3, 81.0), bar("a", 3, 140.0)]]
    stream = arrive(spark, str(tmp_path / "in"), batches, BAR)
    reference = spark.createDataFrame(batches[0], BAR)
    jobs.monitor(stream, reference, ["close"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = {r.batch_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [(rows[k].symbols, rows[k].gaps, rows[k].valid) for k in range(3)] == [(2, 0, True), (2, 1, False), (2, 1, False)]
    assert rows[1].largest_gap == pytest.approx(0.6) and rows[2].largest_gap == pytest.approx(0.4)


def test_reasons_name_the_symbols(spark):
    rows = [bar("a", 1, 100.0), bar("a", 2, 130.0), bar("b", 1, 9.0), bar("b", 2, 9.0, 0.0), ("c", at(2), None, 1.0, float("inf"), 1.0, 5.0, 0.0), bar("d", 1, 1.0)]
    bars = spark.createDataFrame(rows, BAR)
    expected = spark.createDataFrame([("a",), ("d",), ("e",)], "symbol string")
    got = {(r["check"], r["symbol"]): r["value"] for r in quality.session_reasons(bars, expected).collect()}
    assert set(got) == {("gap", "a"), ("no_volume", "b"), ("open", "c"), ("low", "c"), ("absent", "d"), ("absent", "e")}
    assert got["gap", "a"] == pytest.approx(0.3)
    unknown = spark.createDataFrame([("x",)], "symbol string")
    assert quality.session_reasons(bars, unknown).where(F.col("check") == "absent").count() == 0
