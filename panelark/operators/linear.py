"""Linear models for all walk-forward folds from one pass over the panel.

A least-squares fit needs only the sums of products of its columns (the Gram
matrix). Products are summed per stretch of dates between fold borders: each task
reduces its rows to one small matrix per stretch, and a fold's matrix is the sum
over the stretches it trains on. Folds that share dates share their work, selection
inside a fold reads correlations from the same matrix, and the pass costs the same
for three folds as for thirty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelark.operators.folds import fold_dates
from panelark.operators.rows import complete_rows, sanitize
from panelark.schema import TARGET
from panelark.session import cut_lineage

MODEL = "fold int, n long, intercept double, coef array<double>, chosen array<string>"
LEAST_SHARE = 1e-10  # directions with a smaller share of the largest variance are left out of a solution


def _partial(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part = np.asarray(batch.column(0))
            z = np.column_stack([np.ones(len(part)), *[np.asarray(c) for c in batch.columns[1:]]])
            for k in np.unique(part):
                rows = z[part == k]
                sums[k] = sums.get(k, 0.0) + rows.T @ rows
        for k, table in sums.items():
            columns = [np.full(len(upper[0]), k, np.int32), *[u.astype(np.int32) for u in upper], table[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "i", "j", "s"])

    return run


def fold_grams(df: DataFrame, features: Sequence[str], plan: DataFrame, target: str = TARGET, date: str = "timestamp") -> DataFrame:
    """(fold, i, j, s): sums of products over each fold's training rows.

    Columns are numbered 0 for the constant, then the features, then the label;
    i <= j. Rows without a label are left out, missing inputs count as 0. Training
    dates of a fold are consecutive, as ``fold_dates`` makes them. The borders of
    the folds are the only values that reach the driver.
    """
    spans = plan.where("role = 'train'").groupBy("fold").agg(F.min("date_idx").alias("low"), F.max("date_idx").alias("high"))
    borders = sorted({b for r in spans.collect() for b in (r.low, r.high + 1)}) or [0]
    dates = plan.where("role = 'train'").select(date, "date_idx").distinct()
    part = sum([(F.col("date_idx") >= b).cast("int") for b in borders], F.lit(0))
    clean = sanitize(complete_rows(df.select(date, *features, target), [target]), [*features, target])
    rows = clean.join(dates, date).select(part.alias("part"), *features, target)
    sums = rows.mapInArrow(_partial(len(features) + 2), "part int, i int, j int, s double").groupBy("part", "i", "j").agg(F.sum("s").alias("s"))
    # part k holds the dates from border k - 1 up to border k
    number = F.array(*[F.lit(b) for b in borders])
    ranges = spans.select("fold", F.array_position(number, F.col("low")).alias("first"), (F.array_position(number, F.col("high") + 1) - 1).alias("last"))
    each = ranges.select("fold", F.explode(F.sequence("first", "last")).alias("part"))
    return sums.join(F.broadcast(each), "part").groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))


def _solution(gram: np.ndarray, used: list[int]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the used columns; directions without variance get none."""
    n, y = gram[0, 0], len(gram) - 1
    means = gram[0] / n
    moments = gram / n - np.outer(means, means)
    sd = np.sqrt(np.maximum(np.diag(moments), 0.0))
    # a constant column leaves rounding errors behind, not a variance
    live = [k for k in used if sd[k] ** 2 > 1e-13 * max(gram[k, k] / n, 1e-300)]
    coef = np.zeros(len(used))
    if live:
        scaled = moments[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        found = np.linalg.lstsq(scaled, moments[live, y] / sd[live], rcond=LEAST_SHARE)[0] / sd[live]
        coef[[used.index(k) for k in live]] = found
    return float(means[y] - coef @ means[used]), coef


def _correlations(gram: np.ndarray) -> np.ndarray:
    n = gram[0, 0]
    means = gram[0] / n
    moments = gram / n - np.outer(means, means)
    sd = np.sqrt(np.where(np.diag(moments) > 1e-13 * np.maximum(np.diag(gram) / n, 1e-300), np.diag(moments), np.inf))
    return moments / np.outer(sd, sd)


def _fitted(features: list[str], top_k: int | None, max_corr: float, least: float) -> Callable[..., pd.DataFrame]:
    def run(sums: pd.DataFrame, scores: pd.DataFrame | None = None) -> pd.DataFrame:
        if sums.empty:
            return pd.DataFrame(columns=["fold", "n", "intercept", "coef", "chosen"])
        gram = np.zeros((len(features) + 2,) * 2)
        gram[sums["i"], sums["j"]] = gram[sums["j"], sums["i"]] = sums["s"]
        names = features
        if scores is not None and not scores.empty:
            ranked = scores.assign(size=scores["score"].abs()).sort_values(["size", "feature"], ascending=[False, True])
            strong = ranked[ranked["size"] >= least]["feature"].tolist() or ranked["feature"].tolist()
            corr, names = np.abs(_correlations(gram)), []
            for name in strong:
                k = features.index(name) + 1
                if all(corr[k, features.index(other) + 1] <= max_corr for other in names):
                    names.append(name)
            names = names[:top_k]
        intercept, coef = _solution(gram, [features.index(f) + 1 for f in names])
        full = np.zeros(len(features))
        full[[features.index(f) for f in names]] = coef
        return pd.DataFrame([{"fold": sums["fold"].iloc[0], "n": int(gram[0, 0]), "intercept": intercept, "coef": full, "chosen": names}])

    return run


def fit(
    grams: DataFrame, features: Sequence[str], scores: DataFrame | None = None, top_k: int | None = None, max_corr: float = 0.90, least: float = 0.01
) -> DataFrame:
    """One model a fold: fold, n, intercept, coef (one a feature, 0 if not chosen), chosen.

    With ``scores`` (fold, feature, score) a fold uses the features of largest
    absolute score, those of at least ``least`` if there are any, leaves out what
    correlates above ``max_corr`` with one taken before, and keeps ``top_k``.
    """
    build = _fitted(list(features), top_k, max_corr, least)
    if scores is None:
        return grams.groupBy("fold").applyInPandas(lambda sums: build(sums), MODEL)
    # new names, as both sides may come from the same plan of folds
    given = scores.select(*[F.col(c).alias(c) for c in ("fold", "feature", "score")])
    pair = grams.groupBy("fold").cogroup(given.groupBy("fold"))
    return pair.applyInPandas(lambda sums, given: build(sums, given), MODEL)


def predict(df: DataFrame, plan: DataFrame, models: DataFrame, features: Sequence[str], out: str = "prediction", date: str = "timestamp") -> DataFrame:
    """The rows of every fold's test dates with ``fold`` and the prediction of its model."""
    test = plan.where("role = 'test'").select("fold", date)
    clean = sanitize(df.withColumns({f"_x_{f}": F.col(f) for f in features}), [f"_x_{f}" for f in features])
    # one row a fold, a number that the caller sets
    joined = clean.join(test, date).join(F.broadcast(models.select("fold", "intercept", "coef", "chosen")), "fold")
    value = sum([F.col("coef")[k] * F.col(f"_x_{f}") for k, f in enumerate(features)], F.col("intercept"))
    return joined.withColumn(out, value).drop("intercept", "coef", *[f"_x_{f}" for f in features])


def walk_forward(
    df: DataFrame, features: Sequence[str], plan: DataFrame | None = None, target: str = TARGET, splits: int = 6, embargo: int = 6, expanding: bool = True
) -> DataFrame:
    """Out-of-fold predictions of a linear model: (fold, timestamp, symbol, prediction, target, chosen)."""
    plan = plan if plan is not None else cut_lineage(fold_dates(df, splits, embargo, expanding))
    models = fit(fold_grams(df, features, plan, target), features)
    return predict(df, plan, models, features).select("fold", "timestamp", "symbol", "prediction", target, "chosen")


def fold_scores(daily: DataFrame, plan: DataFrame, date: str = "timestamp") -> DataFrame:
    """(fold, feature, score): mean daily IC over each fold's training dates. Daily ICs do not depend on the fold."""
    train = plan.where("role = 'train'").select("fold", date)
    return daily.join(train, date).groupBy("fold", "feature").agg(F.avg("ic").alias("score"))


def nested_walk_forward(
    df: DataFrame, features: Sequence[str], plan: DataFrame | None = None, target: str = TARGET, splits: int = 6, embargo: int = 6,
    top_k: int = 15, max_corr: float = 0.90, min_ic: float = 0.01,
) -> DataFrame:
    """As ``walk_forward``, with features chosen inside every fold from its training dates alone."""
    from panelark.operators import ic

    plan = plan if plan is not None else cut_lineage(fold_dates(df, splits, embargo))
    daily = ic.feature_rank_ic(df, features, target)
    models = fit(fold_grams(df, features, plan, target), features, fold_scores(daily, plan), top_k, max_corr, min_ic)
    return predict(df, plan, models, features).select("fold", "timestamp", "symbol", "prediction", target, "chosen")


def holdout_plan(parts: DataFrame) -> DataFrame:
    """A plan of one fold from a table of dates in parts ``validation`` and ``holdout``."""
    role = F.when(F.col("part") == "holdout", "test").otherwise("train")
    return parts.select(F.lit(1).alias("fold"), role.alias("role"), "timestamp", "date_idx")
