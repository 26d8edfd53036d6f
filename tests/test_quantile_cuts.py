"""Exact bin edges from bracketed quantiles, and jobs of the distribution measures."""

import math
import random

from panelark.operators import selection


def test_cuts_are_exact(spark):
    rng = random.Random(3)
    data = {
        "wide": [rng.lognormvariate(0, 3) for _ in range(30_007)],
        "filled": [0.0 if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(20_001)],
        "one": [2.0] * 40,
        "few": [3.0, 1.0, 2.0],
    }
    long = spark.createDataFrame([(f, v, -v) for f, x in data.items() for v in x], "feature string, x double, y double")
    # a coarse sketch, so that brackets hold many values
    have = {r["feature"]: r for r in selection.quantile_cuts(long, accuracy=200).collect()}
    for f, x in data.items():
        for side, values in (("ex", sorted(x)), ("ey", sorted(-v for v in x))):
            assert have[f][side] == [values[math.ceil(len(x) * i / 10 - 1e-9) - 1] for i in range(1, 10)]


def test_cells_are_counted_once(spark):
    rows = [("f", float(i % 97), float(i % 89)) for i in range(2_000)]
    out = selection.mutual_information(spark.createDataFrame(rows, "feature string, x double, y double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bx" in plan and "LocalRelation" not in plan and "filter(" not in plan


def test_no_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "feature string, x double, y double")
    assert selection.mutual_information(empty).collect() == []
