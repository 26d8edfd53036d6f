"""Rank coefficients from wide rows against those from long rows."""

import random

import pytest
from pyspark.sql import functions as F

from panelark.functions import skew
from panelark.operators import ic

SCHEMA = "timestamp int, a double, b double, c double, future_return_5d double"


def rows(dates=30, seed=3):
    rng = random.Random(seed)
    out = []
    for day in range(dates):
        for _ in range(rng.choice([1, 2, 3, 40])):
            known = rng.random()
            value = rng.choice([None, float("nan"), float("inf")]) if known < 0.2 else rng.gauss(0, 1)
            out.append((day, rng.choice([-0.0, 0.0, 1.0]), value, 4.0, None if known > 0.9 else float(rng.randint(0, 9))))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_wide_and_long_rows_agree(spark, large, request):
    if large:
        request.getfixturevalue("hot")
    df = spark.createDataFrame(rows(), SCHEMA)
    names = ["a", "b", "c"]
    long = ic.long_features(df, names)
    want = {(r.feature, r.timestamp): r.ic for r in ic.daily_rank_ic(long, "x", "y", by=["feature"]).collect()}
    got = {(r.feature, r.timestamp): r.ic for r in ic.feature_rank_ic(df, names).collect()}
    assert want.keys() == got.keys() and {f for f, _ in got} == {"a", "b"}
    assert all(abs(got[k] - want[k]) < 1e-11 for k in want)


def test_groups_are_counted_in_one_job_and_without_values(spark, monkeypatch, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.panelark.skew.smallInputBytes", "0")
    counted = []
    inner = skew.input_bytes
    monkeypatch.setattr(skew, "input_bytes", lambda frame: (counted.append(frame.columns), inner(frame))[1])
    context = spark.sparkContext
    context.setJobGroup("counting", "")
    try:
        ic.daily_rank_ic(df.withColumn("signal", F.col("a") + F.col("c")), "signal")
        jobs = context.statusTracker().getJobIdsForGroup("counting")
    finally:
        spark.conf.unset("spark.panelark.skew.smallInputBytes")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(counted) == 1 and len(jobs) <= 3


def test_stability_shuffles_no_long_rows_by_date(spark):
    long = ic.long_features(spark.createDataFrame(rows(), SCHEMA), ["a", "b"])
    plan = ic.stability(long)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
