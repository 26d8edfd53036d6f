"""Model scores to capped cash weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelark.functions.ranks import average_rank
from panelark.functions.windows import per_group
from panelark.operators.ic import finite
from panelark.operators.rows import first_rows


def cash_weights(
    signals: DataFrame,
    keys: Sequence[str] = ("timestamp",),
    max_names: int = 10,
    max_weight: float = 0.05,
    gross: float = 1.0,
    held: DataFrame | None = None,
    buffer: float = 0.30,
) -> DataFrame:
    """Add ``weight``: equal, capped weights of the best names per book.

    A book takes the top fifth (at most ``max_names``); names already held stay
    while they rank in the buffer. If more names qualify than fit, the first in
    alphabetical order are taken.
    """
    by = list(keys)
    scored = signals.withColumn("_score", F.coalesce(finite("prediction"), F.lit(0.0)))
    ranked = average_rank(scored, "_score", "_place", by, descending=True, ties="min")
    sized = per_group(ranked, by, {"_n": F.count(F.lit(1))})
    n = F.col("_n")
    fits = F.when(n >= 5, F.least(F.lit(max_names), F.greatest(F.lit(1), F.floor(n * 0.20)))).otherwise(
        F.least(F.lit(max_names), n)
    )
    sized = sized.withColumn("_fits", fits.cast("long"))
    reach = F.when(n >= 5, F.greatest(F.col("_fits"), F.floor(n * buffer))).otherwise(F.col("_fits"))
    if held is None:
        sized = sized.withColumn("_held", F.lit(False))
    else:
        on = [k for k in by if k in held.columns] + ["symbol"]
        marks = held.select(*on).distinct().withColumn("_held", F.lit(True))
        sized = sized.join(marks, on, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    able = (F.col("_place") <= F.col("_fits")) | (F.col("_held") & (F.col("_place") <= reach))
    chosen = first_rows(sized.where(able).select(*by, "symbol", "_fits"), max_names, by, "symbol", limit=F.col("_fits"))
    chosen = per_group(chosen, by, {"_count": F.count(F.lit(1))})
    each = F.least(F.lit(max_weight), gross / F.col("_count"))
    weights = chosen.select(*by, "symbol", each.alias("weight"))
    out = signals.join(weights, [*by, "symbol"], "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def shadow_targets(latest: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Weights of the rule books (and a model book) side by side, keyed by strategy."""
    momentum = next((F.col(c) for c in ("momentum_12_1", "return_60d") if c in latest.columns), F.lit(0.0))
    reversal = -F.col("return_5d" if "return_5d" in latest.columns else "return_1d")
    wide = latest.select(
        "timestamp",
        "symbol",
        F.lit(1.0).alias("equal_weight"),
        reversal.alias("reversal_5d"),
        momentum.cast("double").alias("momentum_12_1"),
    )
    rows = wide.unpivot(["timestamp", "symbol"], ["reversal_5d", "momentum_12_1"], "strategy", "prediction")
    if model is not None:
        picked = model.select("timestamp", "symbol", F.lit("full_model").alias("strategy"), "prediction")
        rows = rows.unionByName(picked)
    books = cash_weights(rows, ["strategy", "timestamp"], max_names=10, max_weight=0.05)
    equal = wide.select("timestamp", "symbol", F.lit("equal_weight").alias("strategy"), F.lit(1.0).alias("prediction"))
    return books.unionByName(_equal_book(equal))


def _equal_book(rows: DataFrame) -> DataFrame:
    """The equal book allows every name, but the top-fifth rule still limits how many it holds."""
    sized = per_group(rows, ["strategy", "timestamp"], {"_n": F.count(F.lit(1))})
    n = F.col("_n")
    fits = F.when(n >= 5, F.greatest(F.lit(1), F.floor(n * 0.20))).otherwise(n)
    # every score ties, so the names in alphabetical order fill the book
    placed = average_rank(sized, "symbol", "_place", ["strategy", "timestamp"], ties="min")
    weight = F.when(F.col("_place") <= fits, F.least(1.0 / n, 1.0 / fits)).otherwise(0.0)
    return placed.select("timestamp", "symbol", "strategy", "prediction", weight.alias("weight"))
