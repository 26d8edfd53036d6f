"""Mutual information from wide rows, without a long row for each feature in the counting passes."""

import random

import pytest

from panelark.operators import ic, selection


def test_wide_rows_equal_long_rows(spark, monkeypatch):
    rng = random.Random(9)
    data = [(rng.gauss(0, 1), rng.choice([None, 0.0, 1.5, float("nan")]), rng.choice([None, rng.gauss(0, 1)]), 7.0) for _ in range(3_000)]
    df = spark.createDataFrame([(a, b, c, d, None if i % 50 == 0 else a + rng.gauss(0, 1)) for i, (a, b, c, d) in enumerate(data)],
                               "a double, b double, c double, d double, y double").selectExpr("*", "timestamp'2024-01-01' AS timestamp")
    names = ["a", "b", "c", "d"]
    long = ic.long_features(df, names, "y")
    want = {r["feature"]: r["mutual_info"] for r in selection.mutual_information(long).collect()}
    read = []
    split = selection._of_columns

    def seen(*given):
        pairs = split(*given)
        read.append(pairs.rows.columns)
        return pairs

    monkeypatch.setattr(selection, "_of_columns", seen)
    have = {r["feature"]: r["mutual_info"] for r in selection.feature_information(df, names, "y").collect()}
    assert have == pytest.approx(want, abs=1e-12) and have["a"] > 0.2 and have["d"] == 0
    assert read == [["_y", "_x0", "_x1", "_x2", "_x3"]]


def test_equal_brackets_are_one(spark):
    rows = [("f", 0.0 if i % 10 else float(i), float(i % 7)) for i in range(5_000)]
    long = spark.createDataFrame(rows, "feature string, x double, y double")
    have = selection.quantile_cuts(long).first()
    assert have["ex"] == sorted(r[1] for r in rows)[499:4999:500] and have["ey"] == sorted(r[2] for r in rows)[499:4999:500]
