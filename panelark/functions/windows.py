"""Ordered windows over one entity's series, and skew-safe ways to run them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelark.functions.skew import HotSplit, split_hot

SLICE_ROWS_CONF = "spark.panelark.skew.sliceRows"
SLICE_ROWS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient that is null, not an error, for a zero denominator."""
    return F.try_divide(col(num), col(den))


def zero_null(x: str | Column, fill: float = 0.0) -> Column:
    return F.coalesce(col(x), F.lit(float(fill)))


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(x)))


class Series:
    """Window specifications for the rows of one entity in time order."""

    def __init__(self, keys: Sequence[str] = ("symbol",), order: str = "timestamp"):
        self.keys = list(keys)
        self.order = order
        self.ordered = Window.partitionBy(*self.keys).orderBy(order)

    def roll(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    def so_far(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.ordered)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.ordered)

    def change(self, c: str | Column, n: int = 1) -> Column:
        """Relative change over n rows; null where undefined."""
        return ratio(c, self.lag(c, n)) - 1

    def mean(self, c: str | Column, n: int, least: int = 1) -> Column:
        return self._least(c, n, least, F.avg(col(c)).over(self.roll(n)))

    def std(self, c: str | Column, n: int, least: int = 2) -> Column:
        return self._least(c, n, least, F.stddev_samp(col(c)).over(self.roll(n)))

    def highest(self, c: str | Column, n: int) -> Column:
        return F.max(col(c)).over(self.roll(n))

    def lowest(self, c: str | Column, n: int) -> Column:
        return F.min(col(c)).over(self.roll(n))

    def _least(self, c: str | Column, n: int, least: int, value: Column) -> Column:
        if least <= 1:
            return value
        return F.when(F.count(col(c)).over(self.roll(n)) >= least, value)


def safe_corr(x: Column, y: Column, window=None) -> Column:
    """Pearson correlation, null on a constant side (``corr`` raises there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(px, py), F.stddev_pop(px), F.stddev_pop(py)]
    if window is not None:
        parts = [p.over(window) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, Series], DataFrame],
    keys: Sequence[str] = ("symbol",),
    order: str = "timestamp",
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Apply window columns that look at most ``before`` rows back and ``after`` ahead.

    Without hot entities this is ``build`` on windows partitioned by ``keys``:
    one exchange. A hot entity is cut into slices of consecutive rows; each
    slice also receives copies of the neighbouring rows its frames reach, and
    the copies are dropped afterwards.
    """
    keys = list(keys)
    split = split_hot(df, keys, order)
    if split is None:
        return build(df, Series(keys, order))
    size = max(int(df.sparkSession.conf.get(SLICE_ROWS_CONF, str(SLICE_ROWS))), before + after + 1)
    in_range = Window.partitionBy(*keys, "_range").orderBy(order)
    place = F.row_number().over(in_range) + F.col("_base") - 1
    own = (F.col("_place") / size).cast("long")
    offset = F.col("_place") % size
    copies = F.array_compact(
        F.array(
            F.struct(own.alias("_slice"), F.lit(True).alias("_own")),
            F.when(offset >= size - before, F.struct((own + 1).alias("_slice"), F.lit(False).alias("_own"))),
            F.when((offset < after) & (own > 0), F.struct((own - 1).alias("_slice"), F.lit(False).alias("_own"))),
        )
    )
    single = F.array(F.struct(F.lit(0).cast("long").alias("_slice"), F.lit(True).alias("_own")))
    names = df.columns
    sliced = (
        split.attach(df)
        .withColumn("_place", place)
        .withColumn("_copies", F.when(F.col("_in_range").isNull(), single).otherwise(copies))
        .select(*names, F.inline("_copies"))
    )
    built = build(sliced, Series([*keys, "_slice"], order))
    return built.where("_own").drop("_slice", "_own")


def running(
    df: DataFrame,
    totals: dict[str, Column],
    keys: Sequence[str] = ("symbol",),
    order: str = "timestamp",
    how: str = "sum",
) -> DataFrame:
    """Cumulative sum, max or product of expressions along each series, split-safe.

    In a hot series each range accumulates on its own and then takes on the
    total of the ranges below, which come from a partial aggregate with one row
    per range.
    """
    keys = list(keys)
    fold = {"sum": F.sum, "max": F.max, "product": F.product}[how]
    split = split_hot(df, keys, order)
    if split is None:
        w = Series(keys, order).so_far()
        return df.withColumns({name: fold(expr).over(w) for name, expr in totals.items()})
    named = split.attach(df.withColumns({f"_x_{n}": e for n, e in totals.items()}))
    local = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        named.where(F.col("_in_range").isNotNull())
        .groupBy(*keys, "_range")
        .agg(*[fold(f"_x_{n}").alias(f"_t_{n}") for n in totals])
        .select(*keys, "_range", *[fold(f"_t_{n}").over(below).alias(f"_c_{n}") for n in totals])
    )
    out = named.withColumns({n: fold(f"_x_{n}").over(local) for n in totals})
    # at most 2 * MAX_RANGES rows, see the skew module
    out = out.join(F.broadcast(carried), [*keys, "_range"], "left")
    for n in totals:
        have, carry = F.col(n), F.col(f"_c_{n}")
        joint = {"sum": have + carry, "product": have * carry, "max": F.greatest(have, carry)}[how]
        out = out.withColumn(n, F.when(carry.isNull(), have).when(have.isNull(), carry).otherwise(joint))
    return out.select(*df.columns, *[n for n in totals if n not in df.columns])


def per_group(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Add group aggregates to every row.

    A window does it in the exchange the caller needs anyway. With a hot group
    the aggregate is combined before the shuffle and joined back instead.
    """
    keys = list(keys)
    marked = df.withColumn("_one", F.lit(0))
    if split_hot(marked, keys, "_one") is None:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: e.over(w) for n, e in aggs.items()})
    table = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(table, keys)


def fill_gaps(df: DataFrame, column: str, keys: Sequence[str] = ("symbol",), order: str = "timestamp") -> DataFrame:
    """Forward fill then back fill one column inside each series, split-safe."""
    keys = list(keys)
    split = split_hot(df, keys, order)
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    if split is None:
        filled = F.coalesce(
            F.last(column, True).over(w.rowsBetween(*back)), F.first(column, True).over(w.rowsBetween(*ahead))
        )
        return df.withColumn(column, filled)
    named = split.attach(df)
    local = Window.partitionBy(*keys, "_range").orderBy(order)
    ends = (
        named.where(F.col("_in_range").isNotNull() & F.col(column).isNotNull())
        .groupBy(*keys, "_range")
        .agg(F.max_by(column, order).alias("_l"), F.min_by(column, order).alias("_f"))
    )
    every = named.where(F.col("_in_range").isNotNull()).select(*keys, "_range").distinct()
    spine = Window.partitionBy(*keys).orderBy("_range")
    carried = every.join(ends, [*keys, "_range"], "left").select(
        *keys,
        "_range",
        F.last("_l", True).over(spine.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_f", True).over(spine.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    out = named.withColumns(
        {
            "_ff": F.last(column, True).over(local.rowsBetween(*back)),
            "_bf": F.first(column, True).over(local.rowsBetween(*ahead)),
        }
    ).join(F.broadcast(carried), [*keys, "_range"], "left")
    filled = F.coalesce("_ff", "_before", "_bf", "_after")
    return out.withColumn(column, filled).select(*df.columns)


# --- exponentially weighted mean -------------------------------------------------

# A block has so many observations that the weight of everything before it is
# below 1e-30, and short enough that 1 / weight stays far from overflow.
_BLOCK_DECADES = 30.0
# A gap after which the old weight is below this starts a block of its own; the old value then has no effect.
_LEAST_WEIGHT = 1e-30
# Decimal exponents a block may span without overflow.
_LARGEST_DECADES = 280.0


def ewm_block(alpha: float) -> int:
    return math.ceil(_BLOCK_DECADES * math.log(10) / -math.log1p(-alpha))


def ewm_prepare(
    df: DataFrame, s: Series, columns: Sequence[str], alphas: Sequence[float], ranges: Ranges | None = None
) -> DataFrame:
    """Add row numbers, and per column block numbers and gaps to the last observation.

    Blocks are counted in observations of the column, so rows without one stay in
    the block of the last. One block length serves all the given decay rates. In a
    range of a hot series the numbers continue those of the ranges below, and
    blocks start anew; rows before the range's first observation are block 0.
    """
    block = max(ewm_block(a) for a in alphas)
    if block * -math.log10(1.0 - max(alphas)) > _LARGEST_DECADES:
        raise ValueError("decay rates too far apart for one block length")
    here = {f"_ewm_seen_{c}": F.count(c).over(s.so_far()) for c in columns}
    df = df.withColumns({"_ewm_k": F.row_number().over(s.ordered) - 1} | here)
    past = s.ordered.rowsBetween(Window.unboundedPreceding, -1)
    held = {f"_ewm_held_{c}": F.last(F.when(F.col(c).isNotNull(), F.col("_ewm_k")), True).over(past) for c in columns}
    if ranges is not None:
        df = df.withColumns({"_ewm_k": F.col("_ewm_k") + F.col("_base")})
    df = df.withColumns(held | {f"_ewm_own_{c}": F.col(f"_ewm_seen_{c}") for c in columns})
    if ranges is not None:
        df = ranges.below(
            df,
            {f"_ewm_n_{c}": (F.count(c), F.sum) for c in columns}
            | {f"_ewm_last_{c}": (F.max(F.when(F.col(c).isNotNull(), F.col("_ewm_k"))), F.max) for c in columns},
        )
        df = df.withColumns(
            {f"_ewm_seen_{c}": F.col(f"_ewm_seen_{c}") + F.coalesce(F.col(f"_ewm_n_{c}"), F.lit(0)) for c in columns}
            | {f"_ewm_held_{c}": F.coalesce(f"_ewm_held_{c}", f"_ewm_last_{c}") for c in columns}
        )
    df = df.withColumns({f"_ewm_gap_{c}": F.col("_ewm_k") - F.col(f"_ewm_held_{c}") for c in columns})
    # by the slowest decay: no mean still has a weight that matters after such a gap
    longest = math.log(_LEAST_WEIGHT) / math.log1p(-min(alphas))
    begins = {
        c: F.col(c).isNotNull() & (((F.col(f"_ewm_own_{c}") - 1) % block == 0) | F.coalesce(F.col(f"_ewm_gap_{c}") > longest, F.lit(False)))
        for c in columns
    }
    return df.withColumns({f"_ewm_blk_{c}": F.sum(b.cast("int")).over(s.so_far()) for c, b in begins.items()})


def ewm_apply(df: DataFrame, s: Series, specs: Sequence[tuple], ranges: Ranges | None = None) -> DataFrame:
    """Add exponentially weighted means; a spec is (out, column, alpha, least, rows_of).

    ``rows_of`` names the prepared column whose observations the input shares.
    The recursion is an affine map per observation, y = a*y_prev + b. Inside a
    block of rows the maps compose into P = prod(a) and sum(b / P); a block
    starts from the last value of the block before. A missing observation keeps
    y, and lets the old weight decay once more before the next one. The maps of
    whole ranges of a hot series are composed in the same way, see ``Ranges.start``.
    """
    maps: dict[str, Column] = {}
    for out, column, alpha, _least, rows_of in specs:
        x, gap = F.col(column), F.col(f"_ewm_gap_{rows_of}")
        old = F.pow(F.lit(1.0 - alpha), gap)
        first = gap.isNull()
        # the least weight keeps a step's logarithm finite; what it stands for has no effect on a double
        step = F.when(x.isNull() | first, F.lit(1.0)).otherwise(F.greatest(old / (old + alpha), F.lit(_LEAST_WEIGHT)))
        add = F.when(x.isNull(), F.lit(0.0)).when(first, x).otherwise(alpha * x / (old + alpha))
        maps |= {f"_{out}_a": F.ln(step), f"_{out}_b": add}
    names = [spec[0] for spec in specs]
    df = df.withColumns(maps)
    blocks = {spec[0]: f"_ewm_blk_{spec[4]}" for spec in specs}

    def inside(n: str) -> WindowSpec:
        return Window.partitionBy(*s.keys, blocks[n]).orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0)

    df = df.withColumns({f"_{n}_p": F.exp(F.sum(f"_{n}_a").over(inside(n))) for n in names})
    df = df.withColumns({f"_{n}_z": F.col(f"_{n}_p") * F.sum(F.col(f"_{n}_b") / F.col(f"_{n}_p")).over(inside(n)) for n in names})
    carried = {
        n: F.max_by(F.col(f"_{n}_z"), F.col("_ewm_k")).over(Window.partitionBy(*s.keys).orderBy(blocks[n]).rangeBetween(-1, -1))
        for n in names
    }
    value = {n: F.col(f"_{n}_z") + F.col(f"_{n}_p") * F.coalesce(carried[n], F.lit(0.0)) for n in names}
    if ranges is not None:
        # what the range's start value still weighs: nothing once a whole block lies between
        weighs = {n: F.when(F.coalesce(F.col(blocks[n]), F.lit(0)) <= 1, F.col(f"_{n}_p")).otherwise(0.0) for n in names}
        df = df.withColumns({f"_{n}_v": value[n] for n in names} | {f"_{n}_w": weighs[n] for n in names})
        df = ranges.start(df, {n: (f"_{n}_w", f"_{n}_v") for n in names}, "_ewm_k")
        value = {n: F.col(f"_{n}_v") + F.col(f"_{n}_w") * F.coalesce(f"_start_{n}", F.lit(0.0)) for n in names}
    shown = {spec[0]: F.when(F.col(f"_ewm_seen_{spec[4]}") >= max(spec[3], 1), value[spec[0]]) for spec in specs}
    used = [f"_{n}_{part}" for n in names for part in "abpzvw"] + [f"_start_{n}" for n in names]
    return df.withColumns(shown).drop(*used)


class Ranges:
    """The ranges of hot series, as segments that are scanned apart and then put together.

    Tables by range have at most 2 * MAX_RANGES rows, see the skew module; they are
    what is broadcast.
    """

    def __init__(self, split: HotSplit):
        self.keys, self.split = split.keys, split

    def _joined(self, df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table), [*self.keys, "_range"], "left")

    def _totals(self, df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        hot = df.where(F.col("_in_range").isNotNull())
        return hot.groupBy(*self.keys, "_range").agg(*[e.alias(n) for n, e in aggs.items()])

    def below(self, df: DataFrame, totals: dict[str, tuple]) -> DataFrame:
        """Add aggregates over all ranges below the row's own; each is (aggregate of rows, aggregate of ranges)."""
        down = Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        table = self._totals(df, {n: rows for n, (rows, _) in totals.items()})
        return self._joined(df, table.select(*self.keys, "_range", *[fold(n).over(down).alias(n) for n, (_, fold) in totals.items()]))

    def start(self, df: DataFrame, maps: dict[str, tuple[str, str]], place: str) -> DataFrame:
        """Add ``_start_<name>``, the value at which the row's range starts.

        A range maps its start y to w*y + v, with w and v as they stand in its
        last row by ``place``. Maps of neighbouring ranges are composed in
        doubling steps, so the depth is the logarithm of the number of ranges.
        """
        table = self._totals(df, {f"_w_{n}": F.max_by(w, place) for n, (w, _) in maps.items()} | {f"_v_{n}": F.max_by(v, place) for n, (_, v) in maps.items()})
        line = Window.partitionBy(*self.keys).orderBy("_range")
        reach = 1
        while reach < self.split.most_ranges:
            step = {}
            for n in maps:
                w, v = F.col(f"_w_{n}"), F.col(f"_v_{n}")
                step[f"_v_{n}"] = v + w * F.coalesce(F.lag(v, reach).over(line), F.lit(0.0))
                step[f"_w_{n}"] = w * F.coalesce(F.lag(w, reach).over(line), F.lit(1.0))
            table = table.withColumns(step)
            reach *= 2
        starts = [F.lag(f"_v_{n}").over(line).alias(f"_start_{n}") for n in maps]
        return self._joined(df, table.select(*self.keys, "_range", *starts))


class Means:
    """Exponentially weighted means without bias adjustment, in window functions only.

    ``prepare`` numbers the observations of the columns, ``add`` adds means (out,
    column, alpha, least, rows_of) and may be called again on columns derived from
    earlier means, ``finish`` drops what was added on the way. A hot series is
    scanned range by range and the ranges' maps are handed on, so values are the
    same whether or not a series is split, however long its gaps are.
    """

    def __init__(self, keys: Sequence[str] = ("symbol",), order: str = "timestamp"):
        self.keys, self.order = list(keys), order

    def prepare(self, df: DataFrame, columns: Sequence[str], alphas: Sequence[float]) -> DataFrame:
        split = split_hot(df, self.keys, self.order)
        self.ranges = None if split is None else Ranges(split)
        self.series = Series(self.keys if split is None else [*self.keys, "_range"], self.order)
        return ewm_prepare(df if split is None else split.attach(df), self.series, columns, alphas, self.ranges)

    def add(self, df: DataFrame, specs: Sequence[tuple]) -> DataFrame:
        return ewm_apply(df, self.series, specs, self.ranges)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop("_range", "_base", "_in_range", *[c for c in df.columns if c.startswith("_ewm_")])


def ewm(df: DataFrame, column: str, alpha: float, out: str, least: int = 0, keys: Sequence[str] = ("symbol",), order: str = "timestamp") -> DataFrame:
    """One exponentially weighted mean of a column along each series."""
    means = Means(keys, order)
    prepared = means.prepare(df, [column], [alpha])
    return means.finish(means.add(prepared, [(out, column, alpha, least, column)]))
