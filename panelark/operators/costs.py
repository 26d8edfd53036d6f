"""Trading cost schedule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelark.schema import RATES


def trade_cost(notional: Column, action: Column, trade_type: Column | str = "delivery") -> Column:
    """Charges of one trade: brokerage, tax, fees, service tax, stamp duty and slippage."""
    kind = F.lit(trade_type) if isinstance(trade_type, str) else trade_type
    delivery = F.lower(kind) == "delivery"
    buy, sell = F.lower(action) == "buy", F.lower(action) == "sell"
    r = RATES
    brokerage = F.when(delivery, 0.0).otherwise(
        F.least(F.lit(r["intraday_brokerage_cap"]), r["intraday_brokerage"] * notional)
    )
    tax = F.when(delivery, r["delivery_tax"]).when(sell, r["intraday_sell_tax"]).otherwise(0.0) * notional
    stamp_rate = F.when(delivery, r["delivery_buy_stamp"]).otherwise(r["intraday_buy_stamp"])
    stamp = F.when(buy, stamp_rate * notional).otherwise(0.0)
    fees = (r["exchange_fee"] + r["regulator_fee"]) * notional
    service = r["service_tax"] * (brokerage + fees)
    slippage = r["slippage_bps"] / 10000.0 * notional
    total = brokerage + tax + fees + service + stamp + slippage
    return F.when(notional > 0, total).otherwise(0.0)


def round_trip_bps(trades: DataFrame, notional: str = "notional", kind: str = "trade_type") -> DataFrame:
    """Buy plus sell charges over notional in basis points per trade type; one way is half."""
    x = F.col(notional)
    both = trade_cost(x, F.lit("buy"), F.col(kind)) + trade_cost(x, F.lit("sell"), F.col(kind))
    out = trades.groupBy(kind).agg((F.try_divide(F.sum(both), F.sum(x)) * 10000.0).alias("round_trip_bps"))
    return out.withColumn("one_way_bps", F.col("round_trip_bps") / 2.0)


def flat_round_trip_bps(delivery: bool = True, notional: float = 100000.0) -> float:
    """Round-trip basis points of a flat delivery or intraday trade, from the rate table."""
    r = RATES
    brokerage = 0.0 if delivery else min(r["intraday_brokerage_cap"], r["intraday_brokerage"] * notional)
    fees = (r["exchange_fee"] + r["regulator_fee"]) * notional
    each = brokerage + fees + r["service_tax"] * (brokerage + fees) + r["slippage_bps"] / 10000.0 * notional
    tax = 2 * r["delivery_tax"] if delivery else r["intraday_sell_tax"]
    stamp = r["delivery_buy_stamp"] if delivery else r["intraday_buy_stamp"]
    return (2 * each + (tax + stamp) * notional) / notional * 10000.0
