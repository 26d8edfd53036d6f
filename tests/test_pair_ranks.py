"""Ranks of pairs in hot groups, block by block."""

import random

import pytest

from panelark.functions.ranks import average_rank, pair_ranks
from panelark.functions.skew import balanced, hot_groups
from panelark.operators import ic


def rows(seed=11):
    rng = random.Random(seed)
    wide = [("a", rng.choice([0.0, -0.0, 2.0, rng.gauss(0, 1)]), rng.choice([1.0, rng.lognormvariate(0, 3)])) for _ in range(1_500)]
    few = [("b", float(rng.randint(0, 5)), rng.gauss(0, 1)) for _ in range(40)]
    one = [("c", 3.0, float(i % 5)) for i in range(200)]
    none = [(None, rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(30)]
    return wide + few + one + none


def test_ranks_equal_windows(hot):
    df = hot.createDataFrame(rows(), "k string, x double, y double")
    found = hot_groups(df, ["k"])
    assert {r["k"] for r in found.rows} == {"a", "c"}
    have = pair_ranks(df, ["k"], found).collect()
    with balanced(["k"]):
        want = average_rank(average_rank(df, "x", "rx", ["k"]), "y", "ry", ["k"]).select("k", "rx", "ry").collect()
    assert sorted(map(tuple, have), key=str) == sorted(map(tuple, want), key=str)


def test_hot_chunks_are_ranked_without_windows(hot):
    rng = random.Random(12)
    data = [(i // 10, f, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1_200) for f in ("p", "q")]
    long = hot.createDataFrame(data, "timestamp int, feature string, x double, y double")
    hot_rows = {r["feature"]: r["stability"] for r in ic.stability(long).collect()}
    plan = ic.stability(long)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    hot.conf.set("spark.panelark.skew.smallInputBytes", str(1 << 30))
    assert hot_rows == pytest.approx({r["feature"]: r["stability"] for r in ic.stability(long).collect()}, abs=1e-9)
