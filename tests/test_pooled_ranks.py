"""Pooled rank correlation of a hot group: ranks of one side are made once."""

import random

from panelark.operators import ic


def test_hot_group_is_ranked_once_a_side(hot):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.0, -0.0, rng.gauss(0, 1)]), float(rng.randint(0, 9))) for _ in range(900)]
    df = hot.createDataFrame(rows, "x double, y double")
    out = ic.pooled_rank_ic(df, "x", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the ranks of x come from a written table, not from another window below that of y
    assert plan.count("+- Window ") <= 2 and "parquet" in plan
    clean = [r for r in rows if r[0] is not None]
    want = hot.createDataFrame(clean, "x double, y double").toPandas().corr("spearman").loc["x", "y"]
    have = out.collect()[0]
    assert have.n == len(clean) and abs(have.ic - want) < 1e-9
