"""Lead screening, price levels and ordered rule gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelark.functions.windows import Series, over_series
from panelark.operators.price import true_range
from panelark.operators.rows import last_rows
from panelark.schema import RULES


def find_leads(bars: DataFrame, watch: DataFrame | None = None, least_rows: int = 10) -> DataFrame:
    """Symbols whose last bar spikes in volume or moves in price.

    The last 31 rows of a symbol are enough, so each symbol is cut to them before
    any window.
    """
    rows = bars if watch is None else bars.join(watch, "symbol", "left_semi")
    tail = last_rows(rows.select("symbol", "timestamp", "open", "high", "low", "close", "volume"), 31)

    def build(d: DataFrame, s: Series) -> DataFrame:
        past = F.avg("volume").over(s.ordered.rowsBetween(-30, -1))
        return d.withColumns(
            {
                "_past": past,
                "_prev": s.lag("close"),
                "_seen": F.row_number().over(s.ordered),
                "_next": s.lead("close"),
            }
        )

    last = over_series(tail, build, before=31, after=1).where(F.col("_next").isNull() & (F.col("_seen") >= least_rows))
    ratio = F.col("volume") / F.when(F.col("_past") > 0, F.col("_past")).otherwise(1.0)
    move = F.when(F.col("_prev") > 0, F.col("close") / F.nullif(F.col("_prev"), F.lit(0.0)) - 1.0).otherwise(0.0)
    leads = last.withColumns({"_ratio": ratio, "_move": move}).where(
        (F.col("_ratio") >= 1.3) | (F.abs("_move") >= 0.015)
    )
    return leads.select(
        "symbol",
        "timestamp",
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.round("_ratio", 2).alias("vol_ratio"),
        F.round(F.col("_move") * 100, 2).alias("price_move_pct"),
    )


def price_levels(bars: DataFrame, as_of: Column) -> DataFrame:
    """Stop, target, yearly range and long mean at each symbol's last row."""

    def build(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumn("_tr", true_range(s))
        return d.withColumns(
            {
                "_atr": s.mean("_tr", 14),
                "_high": s.highest("high", 252),
                "_low": s.lowest("low", 252),
                "_sma": s.mean("close", 200),
                "_next": s.lead("timestamp"),
            }
        )

    tail = last_rows(bars.select("symbol", "timestamp", "high", "low", "close"), 266)
    last = over_series(tail, build, before=266, after=1).where(F.col("_next").isNull())
    price = F.col("close")
    distance = F.greatest(F.col("_atr") * 1.5, price * 0.015)
    rounded = {
        "price": price,
        "entry": price,
        "stop": F.greatest(F.lit(1.0), price - distance),
        "target": price + distance * 2.0,
        "atr_14": F.col("_atr"),
        "high_52w": F.col("_high"),
        "low_52w": F.col("_low"),
        "sma_200": F.col("_sma"),
        "dist_from_52w_high_pct": F.coalesce(F.try_divide(price, F.col("_high")) * 100 - 100, F.lit(0.0)),
    }
    return last.select(
        "symbol",
        *[F.round(e, 2).alias(n) for n, e in rounded.items()],
        F.datediff(as_of, F.col("timestamp")).alias("data_age_days"),
        F.to_date("timestamp").alias("last_date"),
    )


def risk_gate(levels: DataFrame, rules: dict | None = None, loss_today_pct: float = 0.0) -> DataFrame:
    """Verdict and reason by ordered rules. Needs price, entry, stop, data_age_days, high_drift."""
    r = RULES | (rules or {})
    risk = F.coalesce(
        F.greatest(F.lit(0.0), F.try_divide(F.col("entry") - F.col("stop"), F.col("entry")) * 100.0), F.lit(0.0)
    )
    too_wide = (F.col("entry") > 0) & (risk * (r["max_size_pct"] / 100.0) > r["max_loss_pct"])
    gates = [
        (F.lit(loss_today_pct >= r["daily_loss_limit_pct"]), "REJECT", "daily loss limit"),
        (F.col("price") < r["min_price"], "REJECT", "price below minimum"),
        (F.col("data_age_days") > r["max_data_age_days"], "REJECT", "stale data"),
        (F.coalesce(F.col("high_drift"), F.lit(False)), "REJECT", "feature drift"),
        (too_wide, "REDUCE", "stop too wide"),
    ]
    verdict, reason = F.lit("APPROVE"), F.lit("passes all gates")
    for test, outcome, why in reversed(gates):
        verdict = F.when(test, outcome).otherwise(verdict)
        reason = F.when(test, why).otherwise(reason)
    return levels.withColumns({"verdict": verdict, "reason": reason})


def sized_decisions(
    leads: DataFrame, gated: DataFrame, cash: float = 1_000_000.0, rules: dict | None = None
) -> DataFrame:
    """The first leads by volume ratio that pass the gate, with position sizes."""
    r = RULES | (rules or {})
    kept = leads.select("symbol", "vol_ratio", "price_move_pct").join(gated.where("verdict <> 'REJECT'"), "symbol")
    share = F.when(F.col("verdict") == "REDUCE", r["max_size_pct"] * 0.5).otherwise(r["max_size_pct"])
    qty = F.coalesce(F.floor(F.try_divide(cash * share / 100.0, F.col("entry"))), F.lit(0)).cast("long")
    sized = kept.withColumn("qty", qty)
    return sized.orderBy(F.desc("vol_ratio"), "symbol").limit(int(r["max_cards_per_day"]))
