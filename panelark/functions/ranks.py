"""Average ranks inside groups, split-safe for hot groups and heavy ties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.functions.skew import HotGroups, balanced, split_hot, spread_out
from panelark.functions.windows import running
from panelark.session import written

PIECES = 4096  # that a hot group is cut into at most


def _places(ordered: WindowSpec) -> tuple[Column, Column]:
    """First and last place among equal values: one sort, one running frame."""
    upto = F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.rank().over(ordered), upto


def average_rank(
    df: DataFrame, column: str, out: str, groups: Sequence[str] = (), descending: bool = False, ties: str = "average"
) -> DataFrame:
    """Add the rank of ``column`` inside ``groups``; equal values share the mean (or ``min``) rank.

    The column must hold no null. A hot group is ranked range by range with the
    number of rows in lower ranges added. An edge value has a range of its own,
    where the rank is known from the range size alone, so its rows are spread
    over tasks instead of being sorted.
    """
    anchored = df
    keys = list(groups)
    if not keys:
        keys = ["_all"]
        anchored = df.withColumn("_all", F.lit(0))
    split = split_hot(anchored, keys, column)
    if split is None:
        order = F.col(column).desc() if descending else F.col(column)
        low, high = _places(Window.partitionBy(*keys).orderBy(order))
        rank = low if ties == "min" else (low + high) / 2
        return anchored.withColumn(out, rank.cast("double")).select(*df.columns, out)
    placed = split.attach(anchored)
    edge = F.lit(split.exact) & (F.col("_range") % 2 == 1) & F.col("_in_range").isNotNull()
    placed = placed.withColumn("_spread", F.when(edge, F.spark_partition_id()).otherwise(F.lit(-1)))
    low, high = _places(Window.partitionBy(*keys, "_range", "_spread").orderBy(column))
    placed = placed.withColumns(
        {
            "_low": F.col("_base") + F.when(edge, F.lit(1)).otherwise(low),
            "_high": F.col("_base") + F.when(edge, F.col("_in_range")).otherwise(high),
        }
    )
    if descending:
        totals = anchored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        placed = placed.join(totals, keys)
        flipped = {"_low": F.col("_rows") + 1 - F.col("_high"), "_high": F.col("_rows") + 1 - F.col("_low")}
        placed = placed.withColumns(flipped)
    rank = F.col("_low") if ties == "min" else (F.col("_low") + F.col("_high")) / 2
    return placed.withColumn(out, rank.cast("double")).select(*df.columns, out)


def running_counts(df: DataFrame, order: str, sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value) with sums and their running totals ``upto_<name>``.

    Rows of equal value are combined before the shuffle; the running totals are
    split-safe (see ``running``).
    """
    keys = list(groups) or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(0))
    per_value = source.groupBy(*keys, order).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    out = running(per_value, {f"upto_{n}": F.col(n) for n in sums}, keys, order)
    return out if groups else out.drop("_all")


def places(values: np.ndarray) -> np.ndarray:
    """Places from 1; equal values share the mean place."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[first, len(values)])
    out = np.empty(len(values))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def _ranked_blocks(blocked: DataFrame, value: str, block: str, out: str, carried: Sequence[str]) -> DataFrame:
    """(_group, carried, out): ranks of ``value`` within the group, block by block."""
    key = ["_group", block]
    sizes = blocked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.min(value) == F.max(value)).alias("single"))
    # at most twice PIECES blocks a group
    base, listed = {}, []
    below, last = 0, None
    for r in sorted(sizes.collect(), key=lambda r: (r["_group"], r[block])):
        below = below if r["_group"] == last else 0
        base[r["_group"], r[block]] = below
        listed.append((r["_group"], r[block], (below + (r["n"] + 1) / 2) if r["single"] else None))
        below, last = below + r["n"], r["_group"]
    known = blocked.sparkSession.createDataFrame(listed, f"_group int, {block} int, {out} double")
    placed = blocked.join(F.broadcast(known), key)

    def rank(rows: pa.Table) -> pa.Table:
        start = base[rows.column("_group")[0].as_py(), rows.column(block)[0].as_py()]
        found = places(rows.column(value).to_numpy()) + start
        return rows.select(["_group", *carried]).append_column(out, pa.array(found))

    kinds = ", ".join(f"{c} {blocked.schema[c].dataType.simpleString()}" for c in ("_group", *carried))
    mixed = placed.where(F.col(out).isNull()).drop(out)
    ranked = spread_out(mixed, len(listed), *key).groupBy(*key).applyInArrow(rank, f"{kinds}, {out} double")
    # a block of one value needs no sort, so it is not brought together
    return placed.where(F.col(out).isNotNull()).select("_group", *carried, out).unionByName(ranked)


def pair_ranks(pairs: DataFrame, groups: Sequence[str], hot: HotGroups) -> DataFrame:
    """(groups, rx, ry): average ranks of the doubles x and y, without nulls, where some groups are hot.

    Hot groups are cut into blocks of consecutive values by a sketch, on either side.
    A task ranks a block, and the rows in lower blocks are added; a value that fills
    blocks is one of its own, where the rank follows from its size.
    """
    keys, spark = list(groups), pairs.sparkSession
    schema = T.StructType([pairs.schema[k] for k in keys] + [T.StructField("_group", T.IntegerType())])
    named = F.broadcast(spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(hot.rows)], schema))
    rows = pairs.join(named, keys).select("_group", "x", "y")
    sketch = [F.percentile_approx(c, [i / PIECES for i in range(1, PIECES)], 10_000).alias(c) for c in ("x", "y")]
    lowest: dict[str, dict[int, np.ndarray]] = {"x": {}, "y": {}}
    for r in rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *sketch).collect():
        count = max(1, min(PIECES, -(-2 * r["n"] // hot.limit)))
        for side, edges in lowest.items():
            values, times = np.unique([r[side][i * PIECES // count - 1] for i in range(1, count)], return_counts=True)
            edges[r["_group"]] = np.union1d(values, np.nextafter(values[times > 1], np.inf))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, x, y = (batch.column(c).to_numpy() for c in ("_group", "x", "y"))
            blocks = np.zeros((2, len(group)), np.int32)
            for i in np.unique(group):
                own = np.flatnonzero(group == i)
                for block, side, values in zip(blocks, ("x", "y"), (x, y)):
                    block[own] = np.searchsorted(lowest[side][i], values[own], "right")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (group, x, y, *blocks)], ["_group", "x", "y", "bx", "by"])

    # read for the sizes of blocks and for the ranks
    blocked = written(rows.mapInArrow(cut, "_group int, x double, y double, bx int, by int"), "rank-blocks")
    one = written(_ranked_blocks(blocked, "x", "bx", "rx", ["y", "by"]), "ranks")
    both = _ranked_blocks(one, "y", "by", "ry", ["rx"]).join(named, "_group").select(*keys, "rx", "ry")
    if sum(r["_n"] for r in hot.rows) == hot.total:
        return both
    with balanced(keys):
        others = average_rank(pairs.join(named, keys, "left_anti"), "x", "rx", keys)
        others = average_rank(others, "y", "ry", keys)
    return both.unionByName(others.select(*keys, "rx", "ry"))
