"""Forest models inside embargoed walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelark.functions.windows import zero_null
from panelark.operators import ic
from panelark.operators.folds import fold_dates
from panelark.operators.rows import complete_rows, sanitize
from panelark.operators.selection import composite_score, prune_redundant
from panelark.schema import BASELINE_FEATURES, TARGET
from panelark.session import cut_lineage

Factory = Callable[[], Estimator]


def forest(trees: int = 80, depth: int = 6, seed: int = 42, label: str = TARGET) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol="_features", featureSubsetStrategy="all"
    )


def fit(train: DataFrame, features: Sequence[str], estimator: Estimator | None = None, target: str = TARGET) -> PipelineModel:
    """Fit on labelled rows with cleaned inputs."""
    rows = sanitize(complete_rows(train.select(*features, target), [target]), [*features, target])
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features"), estimator or forest(label=target)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Add predictions; a missing input column is an error."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"model inputs missing from the frame: {absent}")
    clean = df.withColumns({f"_raw_{f}": F.col(f) for f in features})
    scored = model.transform(sanitize(clean, features)).drop("_features")
    if out != "prediction":
        scored = scored.withColumnRenamed("prediction", out)
    return scored.withColumns({f: F.col(f"_raw_{f}") for f in features}).drop(*[f"_raw_{f}" for f in features])


def baseline_model(train: DataFrame, target: str = TARGET) -> tuple[PipelineModel, list[str]]:
    """Forest on price and volume changes only."""
    features = [c for c in BASELINE_FEATURES if c in train.columns]
    return fit(train, features, forest(100, 5, label=target), target), features


def tree_importance(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """(feature, model_importance) of a small forest on all labelled rows."""
    model = fit(df, features, forest(20, 6, label=target), target)
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, model_importance double")


def _part(df: DataFrame, folds: DataFrame, fold: int, role: str) -> DataFrame:
    dates = folds.where((F.col("fold") == fold) & (F.col("role") == role)).select("timestamp")
    return df.join(dates, "timestamp", "left_semi")


def fold_numbers(folds: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in folds.select("fold").distinct().collect())


def walk_forward(
    df: DataFrame,
    features: Sequence[str] | dict[int, Sequence[str]],
    folds: DataFrame | None = None,
    factory: Factory | None = None,
    target: str = TARGET,
    splits: int = 6,
    embargo: int = 6,
) -> DataFrame:
    """Out-of-fold predictions: (fold, timestamp, symbol, prediction, target).

    The loop runs over folds, a number the caller sets; each fit is a distributed
    job. ``features`` may differ per fold.
    """
    plan = folds if folds is not None else cut_lineage(fold_dates(df, splits, embargo))
    parts = []
    for fold in fold_numbers(plan):
        names = list(features[fold]) if isinstance(features, dict) else list(features)
        model = fit(_part(df, plan, fold, "train"), names, factory() if factory else forest(label=target), target)
        scored = predict(model, _part(df, plan, fold, "test"), names)
        parts.append(scored.select(F.lit(fold).alias("fold"), "timestamp", "symbol", "prediction", target))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_metrics(predictions: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean daily rank IC and RMSE per fold."""
    daily = ic.daily_rank_ic(predictions, "prediction", target, by=["fold"])
    ics = daily.groupBy("fold").agg(F.avg("ic").alias("ic"))
    gap = F.col("prediction") - F.col(target)
    errors = complete_rows(predictions, [target]).groupBy("fold").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return errors.join(ics, "fold", "left").select("fold", zero_null("ic").alias("ic"), "rmse")


def pooled_metrics(predictions: DataFrame, target: str = TARGET) -> DataFrame:
    """RMSE, R2 and sign hit rate over all labelled out-of-fold rows: one aggregate."""
    p, y = F.col("prediction"), F.col(target)
    error = F.avg((y - p) * (y - p))
    same = (F.signum(p) == F.signum(y)).cast("double")
    return complete_rows(predictions, [target]).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(error).alias("rmse"),
        (1.0 - F.try_divide(error, F.var_pop(y))).alias("r2"),
        F.avg(same).alias("hit_rate"),
    )


def nested_scores(df: DataFrame, features: Sequence[str], folds: DataFrame, target: str = TARGET) -> DataFrame:
    """IC statistics and stability per (fold, feature) on the fold's training dates.

    The daily ICs do not depend on the fold, so they are computed once and then
    aggregated per fold, all folds in one job.
    """
    long = ic.long_features(df, features, target)
    daily = cut_lineage(ic.feature_rank_ic(df, features, target))
    train = folds.where("role = 'train'").select("fold", "timestamp")
    stats = ic.ic_statistics(daily.join(train, "timestamp"), ["fold", "feature"])
    steady = None
    for fold in fold_numbers(folds):
        dates = train.where(F.col("fold") == fold).select("timestamp")
        numbered = ic.calendar(dates)
        part = ic.stability(long.join(dates, "timestamp", "left_semi"), numbered).withColumn("fold", F.lit(fold))
        steady = part if steady is None else steady.unionByName(part)
    return cut_lineage(stats.join(steady, ["fold", "feature"], "left").fillna(0.0, ["stability"]))


def nested_selection(
    df: DataFrame,
    features: Sequence[str],
    folds: DataFrame,
    target: str = TARGET,
    top_k: int = 15,
    min_ic: float = 0.01,
    max_corr: float = 0.90,
    fallback: int = 10,
) -> dict[int, list[str]]:
    """Feature names per fold, chosen from the fold's training rows only.

    Where no feature reaches ``min_ic``, the ``fallback`` best ones are pruned instead.
    """
    scores = nested_scores(df, features, folds, target)
    chosen: dict[int, list[str]] = {}
    for fold in fold_numbers(folds):
        train = _part(df, folds, fold, "train")
        importance = tree_importance(train, features, target)
        table = scores.where(F.col("fold") == fold).join(importance, "feature", "left").fillna(0.0)
        ranked = composite_score(table).orderBy(F.desc("score"), "feature").select("feature", "mean_ic").collect()
        names = [r["feature"] for r in ranked if abs(r["mean_ic"]) >= min_ic] or [r["feature"] for r in ranked[:fallback]]
        chosen[fold] = prune_redundant(train, names, max_corr, top_k) or list(features)[:top_k]
    return chosen


def nested_walk_forward(
    df: DataFrame,
    features: Sequence[str],
    splits: int = 6,
    embargo: int = 6,
    top_k: int = 15,
    factory: Factory | None = None,
    target: str = TARGET,
) -> tuple[DataFrame, dict[int, list[str]]]:
    """Walk-forward with selection inside every training fold."""
    folds = cut_lineage(fold_dates(df, splits, embargo))
    chosen = nested_selection(df, features, folds, target, top_k)
    return walk_forward(df, chosen, folds, factory, target), chosen


