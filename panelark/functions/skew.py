"""Detection and splitting of hot groups.

A window partitioned by a key puts every row of one key into one task. That is
fine until one key holds a large share of the table. ``split_hot`` finds such
keys and returns a small table that cuts each of them into value ranges; the
window helpers then partition by (key, range) and add exact offsets.

Sizes are bounded by construction: a group is hot only above
``max(min_rows, total / MAX_RANGES)`` rows, so there are at most ``MAX_RANGES``
hot groups and at most ``2 * MAX_RANGES`` ranges whatever the table size. That
bounded table is what reaches the driver and what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGES = 8192
RANGES_PER_CHUNK = 64
SMALL_INPUT_CONF = "spark.panelark.skew.smallInputBytes"
MIN_ROWS_CONF = "spark.panelark.skew.minRows"
SMALL_INPUT_BYTES = 256 * 1024 * 1024
MIN_ROWS = 2_000_000
DEALT_BYTES_CONF = "spark.panelark.dealtBytes"
DEALT_BYTES = 2 << 20  # of input files behind one partition of a wide frame
COLUMNS_PER_TASK = 4  # that a task may hold of the largest group that is not hot


def input_bytes(df: DataFrame) -> int | None:
    """Estimated bytes of the plan's leaves (files, local rows); None if unknown."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # a session without a JVM handle
        return None


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def order_value(df: DataFrame, order: str) -> Column:
    """Monotone double image of an ordering column, used only to pick ranges."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(order)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(order)).cast("double")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.substring(F.hex(F.col(order)), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(order).cast("double")


@dataclass
class HotSplit:
    """Ranges of the hot groups: keys, nested edges, offset and size per range."""

    keys: list[str]
    order: str
    table: DataFrame
    exact: bool  # distinct values have distinct images
    most_ranges: int = 0  # of any one group

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_range``, ``_base`` (rows of the group in lower ranges) and ``_in_range``.

        An edge value is a range of its own (odd number), so a value that fills
        a large part of a group never shares a range with other values. Rows of
        groups that are not hot get range 0, base 0 and a null ``_in_range``.
        """
        value = order_value(df, self.order)
        joined = df.join(F.broadcast(self.table), self.keys, "left")
        chunk = F.size(F.filter("_chunk_ends", lambda e: e < value))
        inner = F.coalesce(F.get("_edges", chunk), F.array().cast("array<double>"))
        below = F.size(F.filter(inner, lambda e: e < value))
        up_to = F.size(F.filter(inner, lambda e: e <= value))
        number = 2 * RANGES_PER_CHUNK * chunk + below + up_to
        return (
            joined.withColumn("_range", F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(number))
            .withColumn("_base", F.coalesce(F.get("_bases", F.col("_range")), F.lit(0)).cast("long"))
            .withColumn("_in_range", F.get("_counts", F.col("_range")))
            .drop("_edges", "_chunk_ends", "_bases", "_counts")
        )


def _nest(edges: list[float]) -> list[list[float]]:
    return [edges[i : i + RANGES_PER_CHUNK] for i in range(0, len(edges), RANGES_PER_CHUNK)]


_BALANCED: ContextVar[frozenset] = ContextVar("balanced_keys", default=frozenset())


@contextmanager
def balanced(keys: Sequence[str]) -> Iterator[None]:
    """Plans built inside take the groups of ``keys`` as checked and not hot.

    For chains of steps that keep the rows of a frame whose groups were counted
    once, so that not every step counts them again.
    """
    token = _BALANCED.set(_BALANCED.get() | {tuple(keys)})
    try:
        yield
    finally:
        _BALANCED.reset(token)


def row_limit(df: DataFrame) -> int:
    """Rows that a group may have without being hot, whatever the size of the table."""
    return _setting(df, MIN_ROWS_CONF, MIN_ROWS)


def is_large(df: DataFrame) -> bool:
    """Whether the input is large enough to be checked for hot groups."""
    size = input_bytes(df)
    return size is None or size >= _setting(df, SMALL_INPUT_CONF, SMALL_INPUT_BYTES)


def is_balanced(keys: Sequence[str]) -> bool:
    """Whether the groups of ``keys`` were checked and none is hot."""
    return tuple(keys) in _BALANCED.get()


@dataclass
class HotGroups:
    """Hot groups with their numbers of rows ``_n``, and above which number a group is hot."""

    rows: list[Row]
    limit: int
    total: int


def hot_groups(df: DataFrame, keys: Sequence[str]) -> HotGroups | None:
    """The hot groups of ``keys``; None, without a job on a small input, if there is none."""
    if is_balanced(keys) or not is_large(df):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(_setting(df, MIN_ROWS_CONF, MIN_ROWS), total // MAX_RANGES)
    if largest <= limit:
        return None
    return HotGroups(counts.where(F.col("_n") > limit).collect(), limit, total)


def spread_out(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over partitions that are not merged by size, as a task's work is in its groups."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(MAX_RANGES // 2, groups)), *keys)


def split_hot(df: DataFrame, keys: Sequence[str], order: str) -> HotSplit | None:
    """Find hot groups of ``keys`` and cut them into ranges of ``order``.

    Returns None, without running a job, when the input is too small to hold a
    hot group, and None after one narrow counting job when no group is hot.
    """
    keys = list(keys)
    hot = hot_groups(df, keys)
    if hot is None:
        return None
    found, limit = hot.rows, hot.limit

    spark = df.sparkSession
    key_fields = [df.schema[k] for k in keys]
    wanted = T.StructType(key_fields + [T.StructField("_pieces", T.IntegerType())])
    pieces = spark.createDataFrame([(*[r[k] for k in keys], -(-r["_n"] // limit)) for r in found], wanted)
    hot_rows = df.join(F.broadcast(pieces), keys)
    fractions = [i / 4096 for i in range(1, 4096)]
    sketch = hot_rows.groupBy(*keys).agg(
        F.percentile_approx(order_value(df, order), fractions, 10000).alias("_q"),
        F.first("_pieces").alias("_pieces"),
    )
    step = F.greatest(F.lit(1), (F.lit(4096) / F.col("_pieces")).cast("int"))
    picked = sketch.select(
        *keys,
        F.array_sort(F.array_distinct(F.filter("_q", lambda e, i: (i + 1) % step == 0))).alias("_flat"),
    ).collect()

    def table(rows: list[tuple]) -> DataFrame:
        fields = key_fields + [
            T.StructField("_edges", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("_chunk_ends", T.ArrayType(T.DoubleType())),
            T.StructField("_bases", T.ArrayType(T.LongType())),
            T.StructField("_counts", T.ArrayType(T.LongType())),
        ]
        return spark.createDataFrame(rows, T.StructType(fields))

    edges = {tuple(r[k] for k in keys): _nest(list(r["_flat"])) for r in picked}
    bare = [(*key, nested, [part[-1] for part in nested], [], []) for key, nested in edges.items()]
    exact = not isinstance(df.schema[order].dataType, (T.StringType, T.LongType))
    split = HotSplit(keys, order, table(bare), exact)
    sizes: dict[tuple, dict[int, int]] = {}
    per_range = split.attach(df.join(F.broadcast(pieces.drop("_pieces")), keys, "left_semi"))
    for row in per_range.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).collect():
        sizes.setdefault(tuple(row[k] for k in keys), {})[row["_range"]] = row["_n"]
    full = []
    for key, nested in edges.items():
        counts_of = [sizes[key].get(number, 0) for number in range(max(sizes[key]) + 1)]
        bases = [0, *accumulate(counts_of)][:-1]
        full.append((*key, nested, [part[-1] for part in nested], bases, counts_of))
    return HotSplit(keys, order, table(full), exact, max(len(row[-1]) for row in full))


def fits_a_task(df: DataFrame, keys: Sequence[str], columns: int) -> bool:
    """Whether a task can hold any one group of ``keys`` with so many columns; counts keys only, if the input is large."""
    if not is_large(df):
        return True
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    return largest * max(1, columns / COLUMNS_PER_TASK) <= _setting(df, MIN_ROWS_CONF, MIN_ROWS)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by ``keys`` over a number of partitions that grows with the input, for wide frames without hot groups.

    Partitions of a shuffle are merged at run time by their packed size, which says
    little about what a task holds once windows have added many columns.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-(input_bytes(df) or 0) // _setting(df, DEALT_BYTES_CONF, DEALT_BYTES))
    return df.repartition(max(least, wanted), *keys)


def checked_once(df: DataFrame, keys: Sequence[str], order: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` for a chain of steps that keep the rows of ``df``: its groups are counted once if none is hot."""
    if split_hot(df, keys, order) is not None:
        return build()
    with balanced(keys):
        return build()
