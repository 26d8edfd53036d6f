"""Sorted sinks: order, clustering and pruning."""

import datetime as dt

from pyspark.sql import functions as F

from panelark.sources import sinks


def bars(spark, heavy=4000):
    rows = [(dt.datetime(2024, 1, 1 + d), f"S{(i * 7919) % n:05d}", float(i)) for d, n in enumerate([heavy, 20, 5]) for i in range(n)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, close double").repartition(7)


def test_files_are_sorted_and_a_heavy_date_has_many(spark, tmp_path):
    sinks.write_bars(bars(spark), str(tmp_path / "b"), file_rows=500)
    back = spark.read.parquet(str(tmp_path / "b"))
    rows = back.select("date", "symbol", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i")).collect()
    files = {}
    for r in sorted(rows, key=lambda r: (r.file, r.i)):
        files.setdefault((str(r.date), r.file), []).append(r.symbol)
    assert all(names == sorted(names) for names in files.values())
    heavy = sorted((n[0], n[-1]) for (date, _), n in files.items() if date == "2024-01-01")
    assert len(heavy) >= 8 and all(a[1] <= b[0] for a, b in zip(heavy, heavy[1:]))
    assert len(rows) == 4025


def test_reads_by_date_skip_folders_and_by_symbol_push_down(spark, tmp_path):
    sinks.write_bars(bars(spark), str(tmp_path / "b"))
    one = spark.read.parquet(str(tmp_path / "b")).where("date = DATE '2024-01-02' AND symbol = 'S00003'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(symbol,S00003)" in plan
    assert [r.close for r in one.collect()] == [next(float(i) for i in range(20) if (i * 7919) % 20 == 3)]


def test_months_csv_and_tables_without_folders(spark, tmp_path):
    df = bars(spark, 50)
    sinks.write_bars(df, str(tmp_path / "m"), unit="month")
    assert [str(r.date) for r in spark.read.parquet(str(tmp_path / "m")).select("date").distinct().collect()] == ["2024-01-01"]
    sinks.write_bars(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 75
    sinks.write_sorted(df, str(tmp_path / "s"), ["symbol"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 75
