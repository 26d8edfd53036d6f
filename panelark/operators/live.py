"""Position keeping: valuation, orders, fills, history and signal logs as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelark.functions.windows import Series, over_series, running
from panelark.operators.costs import trade_cost
from panelark.operators.ic import daily_rank_ic
from panelark.schema import BENCH_COL, LEDGER, TARGET
from panelark.session import cut_lineage

GENESIS = "0" * 64
LEAF_ROWS = 1000


def mark_to_market(accounts: DataFrame, positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Equity per portfolio: cash plus positions that have a price.

    ``accounts`` (portfolio, cash), ``positions`` (portfolio, symbol, qty),
    ``bars`` one session of (symbol, close).
    """
    priced = positions.join(bars.select("symbol", "close"), "symbol")
    held = priced.groupBy("portfolio").agg(F.sum(F.col("qty") * F.col("close")).alias("held"))
    out = accounts.join(held, "portfolio", "left")
    return out.select("portfolio", "cash", (F.col("cash") + F.coalesce("held", F.lit(0.0))).alias("equity"))


def average_turnover(bars: DataFrame, n: int = 20) -> DataFrame:
    """Add the rolling mean of close x volume, in place and without a join."""
    return over_series(
        bars, lambda d, s: d.withColumn(f"adv_{n}d", s.mean(F.col("close") * F.col("volume"), n)), before=n
    )


def rebalance_orders(
    equity: DataFrame, positions: DataFrame, targets: DataFrame, bars: DataFrame, least_value: float = 5000.0
) -> DataFrame:
    """Order per (portfolio, symbol) that moves holdings to target weights at the open.

    Names without an opening price keep their position. A target worth less than
    ``least_value`` keeps the quantity; changes under one unit are skipped.
    """
    old = positions.select("portfolio", "symbol", "qty")
    new = targets.select("portfolio", "symbol", F.col("weight").alias("target_weight"))
    names = old.join(new, ["portfolio", "symbol"], "full_outer")
    rows = names.join(bars, "symbol").where(F.col("open") > 0).join(equity, "portfolio")
    qty = F.coalesce("qty", F.lit(0.0))
    weight = F.coalesce("target_weight", F.lit(0.0))
    wanted = F.col("equity") * weight
    aim = (
        F.when((wanted > 0) & (wanted < least_value), qty)
        .when(weight > 0, F.floor(wanted / F.col("open")).cast("double"))
        .otherwise(0.0)
    )
    rows = rows.withColumns({"old_qty": qty, "target_qty": aim}).withColumn(
        "delta", F.col("target_qty") - F.col("old_qty")
    )
    return rows.where(F.abs("delta") >= 1).drop("qty", "target_weight")


def fill_orders(orders: DataFrame, adv: str = "adv_20d") -> DataFrame:
    """Fill price with volume-dependent slippage, and charges."""
    notional = F.abs("delta") * F.col("open")
    traded = F.greatest(F.coalesce(F.col(adv), F.lit(10_000_000.0)), F.lit(100_000.0))
    share = F.least(F.lit(1.0), notional / traded)
    slip = (5.0 + 10.0 * F.sqrt(share)) / 10000.0
    price = F.col("open") * (1.0 + F.when(F.col("delta") > 0, slip).otherwise(-slip))
    action = F.when(F.col("delta") > 0, F.lit("buy")).otherwise(F.lit("sell"))
    return orders.withColumns(
        {"notional": notional, "action": action, "fill_price": price, "cost": trade_cost(notional, action)}
    )


def settle(accounts: DataFrame, fills: DataFrame) -> DataFrame:
    """Cash after fills, never below zero, with traded notional and cost."""
    spent = fills.groupBy("portfolio").agg(
        F.sum(F.col("delta") * F.col("fill_price") + F.col("cost")).alias("spent"),
        F.sum("notional").alias("traded_notional"),
        F.sum("cost").alias("total_cost"),
    )
    out = accounts.select("portfolio", "cash").join(spent, "portfolio", "left").fillna(0.0)
    return out.select(
        "portfolio", F.greatest(F.lit(0.0), F.col("cash") - F.col("spent")).alias("cash"), "traded_notional", "total_cost"
    )


def positions_after(positions: DataFrame, fills: DataFrame) -> DataFrame:
    """Positions once the fills are booked; untouched ones are kept as they are."""
    kept = positions.join(fills.select("portfolio", "symbol"), ["portfolio", "symbol"], "left_anti")
    booked = fills.where(F.col("target_qty") > 0).select(
        "portfolio", "symbol", F.col("target_qty").alias("qty"), F.col("fill_price").alias("avg_price")
    )
    return kept.where(F.col("qty") > 0).select("portfolio", "symbol", "qty", "avg_price").unionByName(booked)


def kill_switch(history: DataFrame, limit: float = 0.10, key: str = "portfolio", order: str = "timestamp") -> DataFrame:
    """Running peak, drawdown and a pause flag that stays on after the first breach."""
    df = running(history, {"peak": F.col("equity")}, [key], order, how="max")
    drawdown = F.coalesce(F.try_divide(F.col("equity"), F.col("peak")) - 1.0, F.lit(0.0))
    df = df.withColumn("drawdown", drawdown)
    breach = (F.col("drawdown") <= -abs(limit)).cast("int")
    df = running(df, {"_paused": breach}, [key], order, how="max")
    return df.withColumn("paused", F.col("_paused") == 1).drop("_paused")


def upsert_history(entries: DataFrame, keys: Sequence[str], write_order: str) -> DataFrame:
    """One entry per key, the last write wins. A partial aggregate that leaves one row a key before the shuffle."""
    rest = [c for c in entries.columns if c not in keys]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), write_order).alias("_row"))
    return last.select(*keys, "_row.*").select(*entries.columns)


# --- signal log ------------------------------------------------------------------------


def _fixed(x: Column) -> Column:
    """Eight decimals as text."""
    return F.round(x, 8).cast("decimal(28,8)").cast("string")


def log_digests(signals: DataFrame, leaf: int = LEAF_ROWS) -> DataFrame:
    """One digest per (portfolio, signal_date) over its rows in symbol order.

    Rows are hashed in leaves of ``leaf`` rows and the leaf digests once more in
    groups of ``leaf``, so no task gathers a whole date.
    """
    keys = ["portfolio", "signal_date"]
    placed = running(signals, {"_n": F.lit(1)}, keys, "symbol").withColumn("_n", F.col("_n") - 1)
    line = F.concat_ws(":", "symbol", _fixed(F.col("prediction")), _fixed(F.col("weight")))

    def level(df: DataFrame, text: Column) -> DataFrame:
        part = F.floor(F.col("_n") / leaf)
        rows = df.groupBy(*keys, part.alias("_p")).agg(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))).alias("r"))
        joined = F.concat_ws(";", F.transform("r", lambda x: x["t"]))
        return rows.select(*keys, F.col("_p").alias("_n"), F.sha2(joined, 256).alias("digest"))

    leaves = level(placed, line)
    branches = level(leaves, F.col("digest"))
    roots = branches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "digest"))).alias("r"))
    return roots.select(*keys, F.sha2(F.concat_ws(";", F.transform("r", lambda x: x["digest"])), 256).alias("digest"))


def _leaf(date: str | Column, digest: str | Column) -> Column:
    stamp = F.date_format(date, "yyyy-MM-dd HH:mm:ss")
    return F.sha2(F.concat_ws("|", F.lit("0"), stamp, digest), 256)


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("1"), left, right), 256)


def with_leaves(digests: DataFrame) -> DataFrame:
    """Dates with their leaf hashes; a table that holds leaves keeps them."""
    return digests if "leaf" in digests.columns else digests.withColumn("leaf", _leaf("signal_date", "digest"))


def log_tree(digests: DataFrame) -> DataFrame:
    """All nodes (portfolio, level, idx, hash) of the Merkle tree over each log's dates.

    Level 0 has one leaf per date in date order; a node joins two neighbours of
    the level below, and one without a neighbour moves up as it is. Every level
    has half the rows of the one below, so the work is linear in the dates; the
    loop runs over the levels, the logarithm of the longest log.
    """
    placed = running(with_leaves(digests), {"_i": F.lit(1)}, ["portfolio"], "signal_date")
    level = cut_lineage(
        placed.select("portfolio", F.lit(0).alias("level"), (F.col("_i") - 1).cast("long").alias("idx"), F.col("leaf").alias("hash"))
    )
    nodes, longest, number = level, (level.agg(F.max("idx")).first()[0] or 0) + 1, 0
    while longest > 1:
        number, longest = number + 1, -(-longest // 2)
        left, right = (F.max(F.when(F.col("idx") % 2 == side, F.col("hash"))) for side in (0, 1))
        joined = level.groupBy("portfolio", F.shiftright("idx", 1).alias("idx")).agg(left.alias("l"), right.alias("r"))
        hashed = F.when(F.col("r").isNull(), F.col("l")).otherwise(_node(F.col("l"), F.col("r")))
        level = cut_lineage(joined.select("portfolio", F.lit(number).alias("level"), "idx", hashed.alias("hash")))
        nodes = nodes.unionByName(level)
    return nodes


def chain_log(digests: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The log: each date with its digest and leaf, the root before it and the root with it.

    The root over the first k dates follows from the complete subtrees that make
    up k, one for each binary digit of k, so every date is worked out by itself.
    A later date changes no earlier root. The first date stands on GENESIS.
    """
    nodes = log_tree(digests) if nodes is None else nodes
    numbered = running(with_leaves(digests), {"_k": F.lit(1)}, ["portfolio"], "signal_date").withColumn("_k", F.col("_k").cast("long"))
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("_k"), b) == 1)
    wanted = numbered.select("portfolio", "_k", F.explode(digits).alias("level")).withColumn("idx", F.expr("shiftright(_k, level)") - 1)
    peaks = wanted.join(nodes, ["portfolio", "level", "idx"]).groupBy("portfolio", "_k").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    rest = F.slice("p", 2, F.size("p"))
    roots = peaks.select("portfolio", "_k", F.aggregate(rest, F.col("p")[0]["hash"], lambda h, x: _node(x["hash"], h)).alias("sha256"))
    with_root = numbered.join(roots, ["portfolio", "_k"])
    return over_series(
        with_root,
        lambda d, s: d.withColumn("previous_hash", F.coalesce(s.lag("sha256"), F.lit(GENESIS))),
        keys=["portfolio"], order="signal_date", before=1,
    ).select("portfolio", "signal_date", "digest", "leaf", "previous_hash", "sha256")


def append_log(log: DataFrame, digests: DataFrame) -> DataFrame:
    """The log with new dates added; a date that it holds already keeps its first digest."""
    new = digests.join(log, ["portfolio", "signal_date"], "left_anti").select("portfolio", "signal_date", "digest")
    return chain_log(cut_lineage(log.select("portfolio", "signal_date", "digest").unionByName(new)))


def inclusion_proofs(digests: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(portfolio, signal_date, digest, proof, root): what proves that a date is in the log.

    ``proof`` lists (level, left, hash), the nodes to join on the way to the root,
    ``left`` if the node goes to the left. A proof has at most one node a level.
    """
    nodes = cut_lineage(log_tree(digests)) if nodes is None else nodes
    numbered = running(digests, {"_i": F.lit(1)}, ["portfolio"], "signal_date").withColumn("_i", (F.col("_i") - 1).cast("long"))
    tops = nodes.groupBy("portfolio").agg(F.max_by("hash", "level").alias("root"), F.max("level").alias("top"))
    sized = numbered.join(tops, "portfolio")
    levels = F.explode(F.when(F.col("top") > 0, F.sequence(F.lit(0), F.col("top") - 1)))
    steps = sized.select("portfolio", "_i", levels.alias("level")).withColumn("own", F.expr("shiftright(_i, level)"))
    beside = steps.withColumn("idx", F.col("own").bitwiseXOR(F.lit(1))).join(nodes, ["portfolio", "level", "idx"])
    step = F.struct("level", (F.col("idx") < F.col("own")).alias("left"), "hash")
    proofs = beside.groupBy("portfolio", "_i").agg(F.array_sort(F.collect_list(step)).alias("proof"))
    empty = F.array().cast("array<struct<level:int,left:boolean,hash:string>>")
    return sized.join(proofs, ["portfolio", "_i"], "left").select(
        "portfolio", "signal_date", "digest", F.coalesce("proof", empty).alias("proof"), "root"
    )


def proof_holds(date: str = "signal_date", digest: str = "digest", proof: str = "proof", root: str = "root") -> Column:
    """True if joining the nodes of a proof to a date's leaf gives the root."""
    up = F.aggregate(proof, _leaf(date, digest), lambda h, x: F.when(x["left"], _node(x["hash"], h)).otherwise(_node(h, x["hash"])))
    return F.coalesce(up == F.col(root), F.lit(False))


def verify_chain(log: DataFrame) -> DataFrame:
    """Check each date's digest against its leaf, and the roots against the leaves of the log."""
    again = chain_log(cut_lineage(log.select("portfolio", "signal_date", "digest", "leaf")))
    fresh = again.select("portfolio", "signal_date", F.col("previous_hash").alias("_p"), F.col("sha256").alias("_s"))
    roots = (F.col("previous_hash") == F.col("_p")) & (F.col("sha256") == F.col("_s"))
    good = roots & (F.col("leaf") == _leaf("signal_date", "digest"))
    return log.join(fresh, ["portfolio", "signal_date"]).select("portfolio", "signal_date", F.coalesce(good, F.lit(False)).alias("valid"))


# --- ledger documents --------------------------------------------------------------------


def ledger_documents(accounts: DataFrame, positions: DataFrame) -> DataFrame:
    """One JSON ledger per portfolio: account fields and the map of open positions."""
    open_rows = positions.where((F.col("qty") > 0) & (F.upper(F.trim("symbol")) != "CASH"))
    entry = F.struct(
        F.upper(F.trim("symbol")).alias("symbol"), F.struct(F.col("qty"), F.col("avg_price")).alias("position")
    )
    maps = open_rows.groupBy("portfolio").agg(F.map_from_entries(F.collect_list(entry)).alias("positions"))
    rows = accounts.join(maps, "portfolio", "left")
    empty = F.from_json(F.lit("{}"), "map<string,struct<qty:double,avg_price:double>>")
    rows = rows.withColumn("positions", F.coalesce("positions", empty))
    fields = [f.name for f in LEDGER.fields if f.name in rows.columns]
    return rows.select("portfolio", F.to_json(F.struct(*fields)).alias("ledger"))


def ledger_rows(documents: DataFrame) -> DataFrame:
    """One row per position of each ledger; a CASH row for a ledger without positions."""
    parsed = documents.select("portfolio", F.from_json("ledger", LEDGER).alias("l"))
    rows = parsed.select("portfolio", "l", F.explode_outer("l.positions").alias("symbol", "position"))
    cash = F.coalesce(F.col("l.cash"), F.lit(0.0))
    none = F.col("symbol").isNull()
    qty, price = F.col("position.qty"), F.col("position.avg_price")
    return rows.select(
        "portfolio",
        F.when(none, F.lit("CASH")).otherwise(F.col("symbol")).alias("symbol"),
        F.when(none, 0.0).otherwise(qty).alias("quantity"),
        F.when(none, 1.0).otherwise(price).alias("avg_price"),
        F.when(none, cash).otherwise(qty * price).alias("notional"),
        F.coalesce(F.col("l.last_equity"), F.col("l.cash")).alias("equity"),
        cash.alias("cash"),
        F.coalesce(F.col("l.peak_equity"), F.col("l.cash")).alias("peak_equity"),
        F.coalesce(F.col("l.paused"), F.lit(False)).alias("paused"),
    )


def performance_report(
    bars: DataFrame, history: DataFrame, bench: str = BENCH_COL, target: str = TARGET
) -> DataFrame:
    """Strategy, equal-weight and benchmark returns, with the mean live rank IC.

    ``history`` is (portfolio, timestamp, equity, drawdown); one row per portfolio.
    """
    has_bench = bench in bars.columns
    per_date = bars.groupBy("timestamp").agg(
        F.avg("close").alias("close"), *([F.avg(bench).alias("bench")] if has_bench else [])
    )

    def growth(c: str) -> Column:
        return F.coalesce(F.try_divide(F.max_by(c, "timestamp"), F.min_by(c, "timestamp")) - 1.0, F.lit(0.0))

    market = per_date.agg(
        F.max("timestamp").alias("report_date"),
        growth("close").alias("equal_weight_return"),
        (growth("bench") if has_bench else F.lit(0.0)).alias("benchmark_return"),
    )
    live_ic = F.lit(0.0)
    if "prediction" in bars.columns and target in bars.columns:
        live_ic = daily_rank_ic(bars, "prediction", target).agg(F.coalesce(F.avg("ic"), F.lit(0.0))).scalar()
    books = history.groupBy("portfolio").agg(
        F.max_by("equity", "timestamp").alias("strategy_nav"),
        growth("equity").alias("strategy_return"),
        F.max_by("drawdown", "timestamp").alias("portfolio_drawdown"),
    )
    return books.select(
        "portfolio",
        market.select("report_date").scalar().alias("report_date"),
        "strategy_nav",
        "strategy_return",
        market.select("equal_weight_return").scalar().alias("equal_weight_return"),
        market.select("benchmark_return").scalar().alias("benchmark_return"),
        live_ic.alias("live_rank_ic"),
        "portfolio_drawdown",
    )


