"""Linear walk-forward models against plain least squares of each fold's rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from panelark.operators import linear
from panelark.operators.folds import fold_dates

NAMES = ["a", "b", "twice_a", "flat"]


def panel(spark, days=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for day in range(days):
        for s in range(5):
            a, b = rng.gauss(3, 2), rng.gauss(0, 1)
            y = 0.5 * a - 2 * b + rng.gauss(0, 0.3) + day / 100
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=day), f"S{s}", None if rng.random() < 0.05 else a, b, 2 * a, 7.0, None if rng.random() < 0.1 else y))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, a double, b double, twice_a double, flat double, future_return_5d double")


def plain(df, plan, names):
    """Predictions by fold, each fitted from its own rows."""
    rows, out = df.toPandas(), {}
    where = plan.toPandas()
    for fold, part in where.groupby("fold"):
        train = rows[rows.timestamp.isin(part[part.role == "train"].timestamp)].dropna(subset=["future_return_5d"])
        test = rows[rows.timestamp.isin(part[part.role == "test"].timestamp)]
        design = lambda r: np.column_stack([np.ones(len(r)), r[names].fillna(0.0).to_numpy()])
        coef = np.linalg.lstsq(design(train), train.future_return_5d.to_numpy(), rcond=None)[0]
        out |= {(fold, t, s): p for t, s, p in zip(test.timestamp, test.symbol, design(test) @ coef)}
    return out


def have(predictions):
    return {(r.fold, pd.Timestamp(r.timestamp), r.symbol): r.prediction for r in predictions.collect()}


@pytest.mark.parametrize(("names", "expanding", "splits"), [(["a", "b"], True, 6), (["b"], False, 4), (["a", "b", "flat"], True, 3)])
def test_predictions_equal_plain_least_squares(spark, names, expanding, splits):
    df = panel(spark)
    plan = fold_dates(df, splits, 6, expanding).cache()
    got, want = have(linear.walk_forward(df, names, plan)), plain(df, plan, names)
    assert got.keys() == want.keys() and len({f for f, _, _ in got}) == splits - 1
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_one_pass_serves_all_folds(spark):
    df = panel(spark)
    plan = fold_dates(df, 6).cache()
    grams = linear.fold_grams(df, ["a", "b"], plan)
    rows = df.dropna(subset=["future_return_5d"]).join(plan.where("role = 'train'"), "timestamp").fillna(0.0, ["a", "b"])
    want = rows.selectExpr("fold", "a * b AS p", "b * future_return_5d AS q").groupBy("fold").sum("p", "q").collect()
    got = {(r.fold, r.i, r.j): r.s for r in grams.collect()}
    for fold, p, q in [(r[0], r[1], r[2]) for r in want]:
        assert got[fold, 1, 2] == pytest.approx(p) and got[fold, 2, 3] == pytest.approx(q)
    # a row is read once, whatever the number of folds
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_copies_of_an_input_share_its_weight_and_constants_get_none(spark):
    df = panel(spark).fillna(1.0, ["a"]).withColumn("twice_a", 2 * linear.F.col("a"))
    plan = fold_dates(df, 3).cache()
    both, alone = (have(linear.walk_forward(df, n, plan)) for n in (NAMES, ["a", "b"]))
    assert max(abs(both[k] - alone[k]) for k in alone) < 1e-6
    model = linear.fit(linear.fold_grams(df, NAMES, plan), NAMES).first()
    assert model.coef[3] == 0.0 and len(model.coef) == 4


def test_nested_choice_reads_training_dates_only_and_prunes(spark):
    df = panel(spark).fillna(1.0, ["a"]).withColumn("twice_a", 2 * linear.F.col("a") + linear.F.col("b") * 0.01)
    plan = fold_dates(df, 4).cache()
    rows = linear.nested_walk_forward(df, ["twice_a", "a", "b"], plan, top_k=2).select("fold", "chosen").distinct().collect()
    assert len(rows) == 3
    for r in rows:
        assert len(r.chosen) == 2 and "b" in r.chosen
    # changing what lies after the training dates changes no choice
    later = plan.where("fold = 1 AND role = 'test'").agg({"timestamp": "min"}).first()[0]
    other = df.withColumn("b", linear.F.when(linear.F.col("timestamp") >= later, 0.0).otherwise(linear.F.col("b")))
    first = linear.nested_walk_forward(other, ["twice_a", "a", "b"], plan, top_k=2).where("fold = 1").first()
    assert first.chosen == next(r.chosen for r in rows if r.fold == 1)


def test_holdout_is_a_plan_of_one_fold(spark):
    from panelark.operators.folds import holdout_split

    df = panel(spark)
    plan = linear.holdout_plan(holdout_split(df)).cache()
    got, want = have(linear.walk_forward(df, ["a", "b"], plan)), plain(df, plan, ["a", "b"])
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_folds_without_labelled_training_rows_give_no_rows(spark):
    df = panel(spark, days=12).withColumn("future_return_5d", linear.F.lit(None).cast("double"))
    assert linear.walk_forward(df, ["a"], splits=3).count() == 0
