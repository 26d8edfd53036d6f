"""Feature scoring, ranking and redundancy pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.functions.calendar import calendar
from panelark.functions.windows import safe_corr
from panelark.operators import ic
from panelark.operators.rows import sanitize
from panelark.schema import (
    BENCH_COL,
    KEPT_PREFIXES,
    NOT_FEATURES,
    RAW_LEVEL_PREFIXES,
    SCORE_WEIGHTS,
    TARGET,
)
from panelark.session import cut_lineage, written


def candidate_features(df: DataFrame) -> list[str]:
    """Numeric, scale-free columns by name."""

    def wanted(name: str) -> bool:
        if name in NOT_FEATURES or name in {BENCH_COL, "prev_close"} or name.startswith("future_"):
            return False
        return name.startswith(KEPT_PREFIXES) or not name.startswith(RAW_LEVEL_PREFIXES)

    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and wanted(f.name)]


def without_sentiment(features: Sequence[str]) -> list[str]:
    return [f for f in features if not f.startswith(("indic_", "sentiment_")) and "news" not in f]


Split = Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray, np.ndarray]]]
HELD = "feature string, side string, place int, inside boolean, value double, n long"


@dataclass
class Pairs:
    """Values x and y of features without nulls: a long table, and the rows that tasks split by feature."""

    long: DataFrame
    rows: DataFrame
    split: Split


def _of_long(long: DataFrame) -> Pairs:
    """From (feature, x, y) rows."""

    def split(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        name = batch.column("feature").dictionary_encode()
        number = name.indices.to_numpy()
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        for i, feature in enumerate(name.dictionary.to_pylist()):
            own = number == i
            yield feature, x[own], y[own]

    return Pairs(long, long.select("feature", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), split)


def _of_columns(df: DataFrame, features: Sequence[str], target: str) -> Pairs:
    """From wide rows: a row is read once for all its features."""
    names = list(features)
    values = [ic.finite(f).alias(f"_x{i}") for i, f in enumerate(names)]
    wide = df.select(ic.finite(target).alias("_y"), *values).where(F.col("_y").isNotNull())

    def split(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        y = batch.column("_y").to_numpy(zero_copy_only=False)
        for i, feature in enumerate(names):
            x = batch.column(f"_x{i}").to_numpy(zero_copy_only=False)
            known = ~np.isnan(x)
            yield (feature, x, y) if known.all() else (feature, x[known], y[known])

    return Pairs(ic.long_features(df, names, target), wide, split)


def _brackets(pairs: Pairs, sides: Sequence[str], bins: int, margin: float, accuracy: int) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """Per feature and side: lowest and highest values of disjoint brackets around the cuts, from a sketch."""
    places = [min(1.0, max(0.0, i / bins + d)) for i in range(1, bins) for d in (-margin, margin)]
    sketch = pairs.long.groupBy("feature").agg(*[F.percentile_approx(s, places, accuracy).alias(s) for s in sides])
    found = {}
    # one row per feature: bounded by the width of the schema
    for r in sketch.collect():
        for side in sides:
            low, high = [], []
            for a, b in sorted(zip(r[side][::2], r[side][1::2])):
                if high and a <= high[-1]:
                    high[-1] = max(b, high[-1])
                else:
                    low.append(a)
                    high.append(b)
            found[r["feature"], side] = np.array(low, float), np.array(high, float)
    return found


def _bracketed(pairs: Pairs, sides: Sequence[str], bins: int, margin: float, accuracy: int) -> dict[tuple[str, str, int], float | None]:
    """Per feature, side and cut: the lowest value that the cut's share of the rows reaches, None where the bracket missed it."""
    brackets = _brackets(pairs, sides, bins, margin, accuracy)
    split = pairs.split

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values in a bracket with their numbers of rows; rows between brackets by their place."""
        between: dict[tuple[str, str], np.ndarray] = {}
        fields = ["feature", "side", "place", "inside", "value", "n"]

        def rows(key: tuple[str, str], place: np.ndarray, inside: bool, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            size = len(n)
            columns = [pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.string()), pa.array(place.astype(np.int32)),
                       pa.array(np.full(size, inside)), pa.array(value.astype(float)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, fields)

        for batch in batches:
            for feature, x, y in split(batch):
                for side, values in (("x", x), ("y", y)):
                    if (feature, side) not in brackets:
                        continue
                    low, high = brackets[feature, side]
                    after = np.searchsorted(low, values, "right")
                    inside = (after > 0) & (values <= high[np.maximum(after, 1) - 1])
                    gaps = np.bincount(after[~inside], minlength=len(low) + 1)
                    between[feature, side] = between.get((feature, side), 0) + gaps
                    if inside.any():
                        value, n = np.unique(values[inside], return_counts=True)
                        yield rows((feature, side), np.searchsorted(low, value, "right") - 1, True, value, n)
        for key, gaps in between.items():
            yield rows(key, np.arange(len(gaps)), False, np.zeros(len(gaps)), gaps)

    found = pairs.rows.mapInArrow(held, HELD).groupBy("feature", "side", "place", "inside", "value").agg(F.sum("n").alias("n"))
    # few rows: twice the margin's share of a feature's rows a bracket, equal values as one
    found = written(found, "brackets")
    size = {(r["feature"], r["side"], r["inside"], r["place"]): r["n"] for r in
            found.groupBy("feature", "side", "inside", "place").agg(F.sum("n").alias("n")).collect()}
    cuts: dict[tuple[str, str, int], float | None] = {}
    asked = []
    for (feature, side), (low, _) in brackets.items():
        rows = [size.get((feature, side, kind, place), 0) for place in range(len(low) + 1) for kind in (False, True)][:-1]
        upto = np.cumsum(rows)
        for cut in range(bins - 1):
            # the first place that holds the cut's share, in whole numbers
            rank = -(-int(upto[-1]) * (cut + 1) // bins)
            at = int(np.searchsorted(upto, rank))
            cuts[feature, side, cut] = None
            if at % 2:
                asked.append((feature, side, cut, at // 2, int(rank - upto[at - 1])))
    if asked:
        kind = "feature string, side string, cut int, place int, rank long"
        wanted = F.broadcast(pairs.rows.sparkSession.createDataFrame(asked, kind))
        upto = Window.partitionBy("feature", "side", "place").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        steps = found.where("inside").withColumn("_upto", F.sum("n").over(upto)).join(wanted, ["feature", "side", "place"])
        for r in steps.where(F.col("_upto") >= F.col("rank")).groupBy("feature", "side", "cut").agg(F.min("value").alias("value")).collect():
            cuts[r["feature"], r["side"], r["cut"]] = r["value"]
    return cuts


def _cuts(pairs: Pairs, sides: Sequence[str], bins: int, accuracy: int) -> dict[str, dict[str, np.ndarray]]:
    """Exact lower quantiles by feature and side; a bracket that missed its cut is made wider."""
    margin = 2.0 / accuracy
    while True:
        found = _bracketed(pairs, sides, bins, margin, accuracy)
        if all(v is not None for v in found.values()):
            break
        margin *= 8
    return {f: {s: np.array([found[f, s, i] for i in range(bins - 1)]) for s in sides} for f in sorted({f for f, _, _ in found})}


def quantile_cuts(long: DataFrame, sides: Sequence[str] = ("x", "y"), bins: int = 10, accuracy: int = 10_000) -> DataFrame:
    """(feature, e<side>): the exact lower quantiles that cut each feature's rows into ``bins``.

    A sketch gives a bracket for each cut, one pass counts the rows below it and the
    values inside. A bracket that missed its cut is made wider.
    """
    cuts = _cuts(_of_long(long), sides, bins, accuracy)
    rows = [(feature, *[own[s].tolist() for s in sides]) for feature, own in cuts.items()]
    return long.sparkSession.createDataFrame(rows, f"feature string, {', '.join(f'e{s} array<double>' for s in sides)}")


def mutual_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of quantile-binned x and y per feature, from (feature, x, y) rows."""
    return _information(_of_long(long), bins)


def feature_information(df: DataFrame, features: Sequence[str], target: str = TARGET, bins: int = 10) -> DataFrame:
    """``mutual_information`` of many features from wide rows."""
    return _information(_of_columns(df, features, target), bins)


def _information(pairs: Pairs, bins: int) -> DataFrame:
    """Bin edges are exact quantiles; a task sends at most bins x bins counts a feature."""
    edges = _cuts(pairs, ("x", "y"), bins, 10_000)
    split = pairs.split

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {feature: np.zeros(bins * bins, np.int64) for feature in edges}
        for batch in batches:
            for feature, x, y in split(batch):
                if feature in edges:
                    own = edges[feature]
                    cells[feature] += np.bincount(np.searchsorted(own["x"], x) * bins + np.searchsorted(own["y"], y), minlength=bins * bins)
        for feature, n in cells.items():
            at = np.flatnonzero(n)
            columns = [pa.array([feature] * len(at), pa.string()), pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "bx", "by", "n"])

    counted = pairs.rows.mapInArrow(count, "feature string, bx int, by int, n long")
    # read for the joint table and its margins
    cells = cut_lineage(counted.groupBy("feature", "bx", "by").agg(F.sum("n").cast("double").alias("n")))
    rows = cells.groupBy("feature", "bx").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("feature", "by").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("all"))
    joint = cells.join(rows, ["feature", "bx"]).join(cols, ["feature", "by"]).join(total, "feature")
    part = F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("feature").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mutual_info"))


def composite_score(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score of |IC|, |ICIR|, stability and importance."""
    w = weights or SCORE_WEIGHTS
    score = (
        w["mean_ic"] * F.abs("mean_ic")
        + w["icir"] * F.least(F.abs("icir"), F.lit(3.0)) / 3.0
        + w["stability"] * F.col("stability")
        + w["importance"] * F.least(F.col("model_importance") * 10, F.lit(1.0))
    )
    return table.withColumn("score", score)


def evaluate_features(
    df: DataFrame, features: Sequence[str], importance: DataFrame | None = None, target: str = TARGET
) -> DataFrame:
    """One row per feature with IC statistics, inference, stability, MI and score."""
    long = ic.long_features(df, features, target)
    daily = cut_lineage(ic.feature_rank_ic(df, features, target))
    table = ic.ic_statistics(daily).join(
        ic.ic_inference(daily, ["feature"]).select("feature", "nw_se", F.col("t_stat").alias("ic_tstat"), "ci_low", "ci_high"),
        "feature",
    )
    table = table.join(ic.stability(long, calendar(df)), "feature", "left").join(feature_information(df, features, target), "feature", "left")
    if importance is None:
        table = table.withColumn("model_importance", F.lit(0.0))
    else:
        table = table.join(importance, "feature", "left")
    filled = table.fillna(0.0, ["stability", "mutual_info", "model_importance"])
    # one row per feature, read again by the filter and the ordering
    return cut_lineage(composite_score(filled))


def shortlist(table: DataFrame, min_ic: float = 0.01, fallback: int = 10) -> DataFrame:
    """Features with |mean IC| at or above the threshold, else the best by score."""
    strong = F.abs("mean_ic") >= min_ic
    passed = table.where(strong)
    none = table.agg(F.coalesce(F.bool_or(strong), F.lit(False)).alias("any")).scalar()
    best = table.orderBy(F.desc("score"), "feature").limit(fallback)
    return passed.unionByName(best.where(~none))


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each feature pair in one aggregate pass; null values read as 0."""
    names = list(features)
    value = {f: F.coalesce(ic.finite(f), F.lit(0.0)) for f in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = df.agg(
        *[F.coalesce(safe_corr(value[a], value[b]), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    listed = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.inline(listed))


def correlation_lookup(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float]:
    """Absolute Pearson correlations of many columns in one pass; constant columns give 0."""
    rows = sanitize(df.select(*names), names)
    vectors = VectorAssembler(inputCols=list(names), outputCol="_v").transform(rows).select("_v")
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    return {
        (a, b): 0.0 if matrix[i, j] != matrix[i, j] else abs(float(matrix[i, j]))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i != j
    }


def prune_redundant(
    df: DataFrame, ranked: Sequence[str], max_corr: float = 0.90, top_k: int | None = None
) -> list[str]:
    """Keep a feature if it is not too correlated with any feature kept before it.

    One Spark pass makes the feature x feature matrix (bounded by the schema
    width); the greedy choice over it is a loop on the driver.
    """
    names = list(ranked)
    if not names:
        return []
    corr = correlation_lookup(df, names) if len(names) > 1 else {}
    kept: list[str] = []
    for name in names:
        if all(corr[name, other] <= max_corr for other in kept):
            kept.append(name)
    return kept[:top_k] if top_k else kept


def select_features(
    df: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    min_ic: float = 0.01,
    max_corr: float = 0.90,
    top_k: int | None = None,
    importance: DataFrame | None = None,
) -> list[str]:
    """Names in score order after the IC filter and redundancy pruning."""
    table = evaluate_features(df, features, importance, target)
    names = [r["feature"] for r in shortlist(table, min_ic).orderBy(F.desc("score"), "feature").select("feature").collect()]
    return prune_redundant(df, names, max_corr, top_k)
