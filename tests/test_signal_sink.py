"""The query on the sink of dated signals: all bars, all dates, prices of zero."""

import datetime as dt

import duckdb

from panelark.plans.catalog import ORACLES, QUERIES
from panelark.sources import sinks


def tables(spark, folder, days=40):
    """Lines of three suppliers, some of them free, and events of value 0."""
    start = dt.datetime(2024, 1, 1)
    lines = [
        (s * 1000 + d, s, 1, 2.0, 0.0 if (d + s) % 9 == 0 else 10.0 + (d * 7 + s) % 5, 0.04, start + dt.timedelta(days=d))
        for s in (1, 2, 3)
        for d in range(days)
    ]
    names = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).write.parquet(f"{folder}/lineitem.parquet")
    events = [(i, start + dt.timedelta(hours=i), 1 + i % 2, "view", 0.0) for i in range(50)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(events, kinds).write.parquet(f"{folder}/events.parquet")


def test_free_lines_and_zero_values_agree_with_the_sql(spark, tmp_path):
    tables(spark, str(tmp_path))
    got = sorted((r.symbol, r.signal_date, r.prediction) for r in QUERIES["dated_signal_sink"](spark, str(tmp_path)).collect())
    base = duckdb.connect()
    for name in ("lineitem", "events"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(base.execute(ORACLES["dated_signal_sink"]).fetchall())
    assert got == want and [r[0] for r in got] == ["S000001", "S000002", "S000003"]


def test_every_date_of_the_bars_is_written(spark, tmp_path, monkeypatch):
    tables(spark, str(tmp_path))
    written = []
    write = sinks.write_signals
    monkeypatch.setattr(sinks, "write_signals", lambda rows, path: (written.append(rows.select("signal_date").distinct().count()), write(rows, path)))
    QUERIES["dated_signal_sink"](spark, str(tmp_path)).collect()
    assert written == [40, 1]
