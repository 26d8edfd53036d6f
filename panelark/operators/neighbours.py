"""Mutual information from nearest neighbours, on all rows.

Both sides are scaled by their standard deviation and kept as whole billionths
of it, so distances are exact integers. Points are cut into slabs of x, about the
square root of their number each; a value that fills slabs is cut by y, so a cell is
no larger whatever the distribution. A task merges the equal points of its cell and
searches it leaf by leaf. Only points whose radius leaves the cell's box visit other
cells: those whose boxes it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from panelark.functions.skew import spread_out
from panelark.session import cut_lineage, written

UNITS = 1e9
CELL_POINTS = 1 << 12  # a slab of n points has about the root of n times this
LEAF_POINTS = 64
BLOCK_ROWS = 1 << 19  # rows of one axis that a task counts in
VISITS_PER_TASK = 1 << 17
PIECES = 4096  # that one feature or one value is cut into at most
CHUNK = 1 << 15  # distances held at once, few enough for a core's cache
FAR = 1 << 61  # beyond all points
NONE = 1 << 60

POINT = ["feature", "px", "py"]
CELL = ["feature", "cell"]
# features are numbers while points are searched
PLACED = "feature int, px long, py long, w long, cell long"
LOCAL = "feature int, px long, py long, w long, bound long, to array<long>, d array<long>, c array<long>"
REMOTE = "feature int, px long, py long, w long, d array<long>, c array<long>"


def digamma(n: Column) -> Column:
    """Digamma of a positive number: six recurrence steps, then the asymptotic series."""
    z = n + 6.0
    inverse = 1.0 / (z * z)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    steps = sum((1.0 / (n + float(i)) for i in range(1, 6)), 1.0 / n)
    return F.ln(z) - 0.5 / z - series - steps


def weighted_points(long: DataFrame) -> DataFrame:
    """Scaled points of (feature, x, y) with a number of rows at each; equal points may come in several rows."""
    spread = long.groupBy("feature").agg(F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))

    def units(value: str, scale: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(value), F.col(scale)) * UNITS), F.lit(0.0)).cast("long")

    # one row per feature: bounded by the width of the schema
    scaled = long.select("feature", "x", "y").join(F.broadcast(spread), "feature")
    return scaled.select("feature", units("x", "_sx").alias("px"), units("y", "_sy").alias("py"), F.lit(1).cast("long").alias("w"))


# --- cutting ------------------------------------------------------------------------


def borders(rows: DataFrame, keys: Sequence[str], column: str, pieces: Callable[[int], float]) -> dict[tuple, np.ndarray]:
    """Lowest values of the pieces after the first, per group; a value that fills pieces is one of its own.

    At most ``PIECES`` a group. They come from a sketch, so sizes are approximate.
    """
    sketch = F.percentile_approx(column, [i / PIECES for i in range(1, PIECES)], 10_000)
    found = {}
    for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("q")).collect():
        count = max(1, min(PIECES, int(pieces(r["n"]))))
        picked = np.array([r["q"][i * PIECES // count - 1] for i in range(1, count)], np.int64)
        values, times = np.unique(picked, return_counts=True)
        found[tuple(r[k] for k in keys)] = np.union1d(values, values[times > 1] + 1)
    return found


def merged(px: np.ndarray, py: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct points in order of x, then y, with their weights."""
    order = np.lexsort((py, px))
    px, py = px[order], py[order]
    first = np.flatnonzero(np.r_[True, (px[1:] != px[:-1]) | (py[1:] != py[:-1])]) if len(px) else np.zeros(0, np.int64)
    return px[first], py[first], np.add.reduceat(w[order], first) if len(px) else w


def numbered(batch: pa.RecordBatch, names: Sequence[str], *columns: str) -> list[np.ndarray]:
    """The numbers of a batch's features, and columns as arrays."""
    feature = pc.index_in(batch.column("feature"), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
    return [feature.astype(np.int32), *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]]


def in_cells(points: DataFrame, cell_points: int) -> tuple[DataFrame, list[str]]:
    """The points with the cell that each is in, and the features by number."""
    lowest = borders(points, ["feature"], "px", lambda n: (n / cell_points) ** 0.5)
    names = sorted(f for (f,) in lowest)
    # a slab of one value holds several slabs' rows: it is cut by y into as many
    single = [(f, int(v)) for (f,), edges in lowest.items() for v in edges[:-1][np.diff(edges) == 1]]
    pieces: dict[tuple, np.ndarray] = {}
    if single:
        wanted = points.sparkSession.createDataFrame(single, "feature string, px long")
        # at most one slab in two of the few that a feature is cut into
        inside = points.join(F.broadcast(wanted), ["feature", "px"])
        pieces = borders(inside, ["feature", "px"], "py", lambda n: (n / cell_points) ** 0.5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, *point = numbered(batch, names, "px", "py", "w")
            parts = []
            for i in np.unique(feature):
                own = feature == i
                # equal points of a batch are one row
                px, py, w = merged(*(c[own] for c in point))
                cell = np.searchsorted(lowest[(names[i],)], px, "right") << 16
                for (name, value), cuts in pieces.items():
                    if name == names[i]:
                        start, end = np.searchsorted(px, value), np.searchsorted(px, value, "right")
                        cell[start:end] += np.searchsorted(cuts, py[start:end], "right")
                parts.append((np.full(len(px), i, np.int32), px, py, w, cell))
            if parts:
                arrays = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["feature", "px", "py", "w", "cell"])

    return points.mapInArrow(place, PLACED), names


# --- the search in a cell -----------------------------------------------------------------


def spans(items: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item with every number from its first up to its end."""
    count = np.maximum(end - first, 0)
    start = np.cumsum(count) - count
    return np.repeat(items, count), np.arange(count.sum()) - np.repeat(start - first, count)


class Leaves:
    """The points of a cell in leaves of about LEAF_POINTS with their boxes, in equal rows of an array."""

    def __init__(self, px: np.ndarray, py: np.ndarray, w: np.ndarray):
        n = len(px)
        count = max(1, n // LEAF_POINTS)
        # leaves about as wide as they are high, where most points are
        wide, high = (max(1.0, float(np.subtract(*np.percentile(v, [90, 10])))) for v in (px, py))
        strips = min(count, max(1, round((count * wide / high) ** 0.5)))
        per = count // strips
        strip = np.empty(n, np.int64)
        # equal x by y, so that strips of one value do not overlap
        strip[np.lexsort((py, px))] = np.arange(n) * strips // n
        self.order = np.lexsort((py, strip))
        strip = strip[self.order]
        first = np.searchsorted(strip, np.arange(strips + 1))
        self.leaf = strip * per + (np.arange(n) - first[strip]) * per // np.diff(first)[strip]
        size = np.bincount(self.leaf, minlength=strips * per)
        slot = np.arange(n) - (np.cumsum(size) - size)[self.leaf]
        shape = (strips * per, size.max())
        self.x, self.y, self.w = np.full(shape, FAR), np.full(shape, FAR), np.zeros(shape, np.int64)
        for into, values in ((self.x, px), (self.y, py), (self.w, w)):
            into[self.leaf, slot] = values[self.order]
        real = self.w > 0
        self.low = self.x.min(axis=1), self.y.min(axis=1)
        self.high = np.where(real, self.x, -FAR).max(axis=1), np.where(real, self.y, -FAR).max(axis=1)
        # strips follow each other in x; those of one value, in y, are one run of leaves
        x0, x1 = self.low[0].reshape(strips, -1).min(axis=1), self.high[0].reshape(strips, -1).max(axis=1)
        again = np.r_[False, (x0[1:] == x1[1:]) & (x0[1:] == x1[:-1]) & (x0[:-1] == x1[:-1])]
        run = np.cumsum(~again) - 1
        self.left, self.right = x0[~again], x1[np.r_[~again[1:], True]]
        # leaves follow each other in y within a run: one number for both
        self.least, tall = self.low[1].min(), self.high[1].max() - self.low[1].min() + 3
        self.tall, run = tall, np.repeat(run, per) * tall
        self.bottom, self.top = run + self.low[1] - self.least + 1, run + self.high[1] - self.least + 1

    def nearest(self, apart: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and weights of the k smallest of each row; weight 0 where there are fewer."""
        rows, take = np.arange(len(apart)), min(k, apart.shape[1])
        far, held = np.empty((len(apart), take), np.int64), np.empty((len(apart), take), np.int64)
        for i in range(take):
            at = apart.argmin(axis=1)
            far[:, i], held[:, i] = apart[rows, at], weight[rows, at]
            apart[rows, at] = np.iinfo(np.int64).max
        return far, np.where(far < NONE, held, 0)

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, distance, weight) of the k nearest other points in each point's leaf; points in leaf order."""
        width = self.x.shape[1]
        step = max(1, CHUNK // (width * width))
        parts = []
        for i in range(0, len(self.x), step):
            x, y, w = (a[i : i + step] for a in (self.x, self.y, self.w))
            apart = np.maximum(np.abs(x[:, :, None] - x[:, None, :]), np.abs(y[:, :, None] - y[:, None, :]))
            apart[:, np.arange(width), np.arange(width)] = np.iinfo(np.int64).max
            real = w.ravel() > 0
            weight = np.broadcast_to(w[:, None, :], apart.shape).reshape(-1, width)[real]
            parts.append(self.nearest(apart.reshape(-1, width)[real], weight, k))
        far, held = (np.concatenate(p) for p in zip(*parts))
        return np.repeat(np.arange(len(far)), far.shape[1]), far.ravel(), held.ravel()

    def met(self, qx: np.ndarray, qy: np.ndarray, reach: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for the leaves whose boxes may hold a point nearer than the reach."""
        first = np.searchsorted(self.right, qx[asks] - reach[asks], "right")
        asked, run = spans(asks, first, np.searchsorted(self.left, qx[asks] + reach[asks], "left"))

        def place(y: np.ndarray) -> np.ndarray:
            return run * self.tall + np.clip(y - self.least + 1, 0, self.tall - 1)

        above = np.searchsorted(self.top, place(qy[asked] - reach[asked]), "right")
        return spans(asked, above, np.searchsorted(self.bottom, place(qy[asked] + reach[asked]), "left"))

    def visit(self, qx: np.ndarray, qy: np.ndarray, reach: np.ndarray, k: int, own: np.ndarray | None = None):
        """(query, distance, weight) of the k nearest points, nearer than the reach, in each leaf that it meets."""
        asks = np.flatnonzero(reach > 0)
        if own is not None:
            # a ball within the own leaf's box holds no point of another
            leaf, x, y, r = own[asks], qx[asks], qy[asks], reach[asks]
            within = (x - r >= self.low[0][leaf]) & (x + r <= self.high[0][leaf]) & (y - r >= self.low[1][leaf]) & (y + r <= self.high[1][leaf])
            asks = asks[~within]
        found = [(np.zeros(0, np.int64),) * 3]
        pairs = max(1, CHUNK // self.x.shape[1])
        for i in range(0, len(asks), CHUNK):
            query, leaf = self.met(qx, qy, reach, asks[i : i + CHUNK])
            if own is not None:
                other = leaf != own[query]
                query, leaf = query[other], leaf[other]
            for j in range(0, len(query), pairs):
                q, at = query[j : j + pairs], leaf[j : j + pairs]
                apart = np.maximum(np.abs(self.x[at] - qx[q, None]), np.abs(self.y[at] - qy[q, None]))
                far, held = self.nearest(apart, self.w[at], k)
                held = np.where(far < reach[q, None], held, 0)
                q = np.repeat(q, far.shape[1])
                kept = held.ravel() > 0
                found.append((q[kept], far.ravel()[kept], held.ravel()[kept]))
        return tuple(np.concatenate(p) for p in zip(*found))


def on_a_line(at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, distance, weight) of the nearest ``k`` other points on either side, for distinct points in order."""
    n, parts = len(at), [(np.zeros(0, np.int64),) * 3]
    for i in range(1, min(k, n - 1) + 1):
        apart = at[i:] - at[:-i]
        parts += [(np.arange(n - i), apart, w[i:]), (np.arange(i, n), apart, w[:-i])]
    return tuple(np.concatenate(p) for p in zip(*parts))


def meets(qx, qy, reach, x0, y0, x1, y1) -> np.ndarray:
    """Whether a box may hold a point nearer than the reach, for each query and box."""
    dx = np.maximum(x0[None, :] - qx[:, None], qx[:, None] - x1[None, :])
    dy = np.maximum(y0[None, :] - qy[:, None], qy[:, None] - y1[None, :])
    return (np.maximum(np.maximum(dx, dy), 0) < reach[:, None])


def first_k(query: np.ndarray, far: np.ndarray, held: np.ndarray, n: int, k: int):
    """Entries up to the k-th row of each query in order of distance, and the distance of that row (-1: fewer)."""
    real = held > 0
    query, far, held = query[real], far[real], held[real]
    order = np.lexsort((far, query))
    query, far, held = query[order], far[order], held[order]
    seen = np.cumsum(held)
    start = np.searchsorted(query, np.arange(n))
    before = np.r_[0, seen]
    within = seen - before[start][query] if len(query) else seen
    bound = np.full(n, -1, np.int64)
    last = (within >= k) & (within - held < k)
    bound[query[last]] = far[last]
    kept = within - held < k
    return (query[kept], far[kept], held[kept]), bound


def lists(query: np.ndarray, values: np.ndarray, wanted: np.ndarray, n: int) -> pd.Series:
    """The values of each wanted query as a list, an empty one for all others."""
    out = [np.zeros(0, np.int64)] * n
    ends = np.searchsorted(query, np.arange(n + 1))
    for i in np.flatnonzero(wanted):
        out[i] = values[ends[i] : ends[i + 1]]
    return pd.Series(out, dtype=object)


def _own_cell(k: int, boxes: dict[str, tuple[np.ndarray, ...]]):
    def search(cell: pd.DataFrame) -> pd.DataFrame:
        px, py, w = merged(*(cell[c].to_numpy(np.int64) for c in ("px", "py", "w")))
        line = py if px[0] == px[-1] else px if py.min() == py.max() else None
        leaves = Leaves(px, py, w) if line is None else None
        if leaves:
            px, py, w = px[leaves.order], py[leaves.order], w[leaves.order]
        n = len(px)
        # rows at the point itself are neighbours at distance 0
        near = [(np.arange(n), np.zeros(n, np.int64), w - 1), leaves.own(k) if leaves else on_a_line(line, w, k)]
        entries, bound = first_k(*(np.concatenate(p) for p in zip(*near)), n, k)
        if leaves:
            more = leaves.visit(px, py, np.where(bound < 0, FAR, bound), k, leaves.leaf)
            entries, bound = first_k(*(np.concatenate(p) for p in zip(entries, more)), n, k)
        reach = np.where(bound < 0, FAR, bound)
        ids, *box = boxes[cell["feature"].iloc[0]]
        # a nearer point of another cell lies outside the own box, or on its border
        inside = (px - reach >= px.min()) & (px + reach <= px.max()) & (py - reach >= py.min()) & (py + reach <= py.max())
        asks = np.flatnonzero(~inside)
        query, target = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CHUNK // len(ids))
        for i in range(0, len(asks), step):
            part = asks[i : i + step]
            q, at = np.nonzero(meets(px[part], py[part], reach[part], *box))
            other = ids[at] != cell["cell"].iloc[0]
            query.append(part[q[other]])
            target.append(ids[at[other]])
        query, target = np.concatenate(query), np.concatenate(target)
        opened = np.bincount(query, minlength=n) > 0
        return pd.DataFrame(
            {
                "feature": cell["feature"].iloc[0], "px": px, "py": py, "w": w, "bound": bound, "to": lists(query, target, opened, n),
                "d": lists(entries[0], entries[1], opened, n), "c": lists(entries[0], entries[2], opened, n),
            }
        )

    return search


def _other_cell(k: int):
    def search(visits: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        qx, qy, own, bound = (visits[c].to_numpy(np.int64) for c in ("px", "py", "w", "bound"))
        n = len(qx)
        if n == 0 or cell.empty:
            entries = (np.zeros(0, np.int64),) * 3
        else:
            leaves = Leaves(*(cell[c].to_numpy(np.int64) for c in ("px", "py", "w")))
            entries, _ = first_k(*leaves.visit(qx, qy, np.where(bound < 0, FAR, bound), k), n, k)
        hit = np.bincount(entries[0], minlength=n) > 0
        name = visits["feature"].to_numpy()
        out = pd.DataFrame({"feature": name, "px": qx, "py": qy, "w": own, "d": lists(entries[0], entries[1], hit, n), "c": lists(entries[0], entries[2], hit, n)})
        return out[hit]

    return search


def _in_parts(many: DataFrame, few: DataFrame, keys: Sequence[str], most: int, *spread: str) -> tuple[DataFrame, DataFrame]:
    """Both tables by ``keys`` and ``_part``: groups of ``many`` in parts of about ``most`` rows, ``few`` copied to each."""
    parts = cut_lineage(many.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")))
    # one row per group, of which there are few
    placed = many.join(F.broadcast(parts), [*keys]).withColumn("_part", F.pmod(F.xxhash64(*spread), "_parts").cast("int"))
    copies = few.join(F.broadcast(parts), [*keys]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def named(df: DataFrame) -> DataFrame:
        # new names for columns that come from the same tables on both sides
        return df.select(*[F.col(c).alias(c) for c in df.columns if c != "_parts"])

    return named(placed), named(copies)


def neighbour_radius(points: DataFrame, k: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """Points with the exact distance within which ``k`` other rows lie.

    Points of a feature with at most ``k`` rows have no such distance and are left out.
    """
    placed, names = in_cells(points, cell_points)
    placed = written(placed, "cells")
    sides = {"x0": F.min("px"), "y0": F.min("py"), "x1": F.max("px"), "y1": F.max("py")}
    # one row per cell
    corners: dict[int, list[Row]] = {}
    cells = placed.groupBy(*CELL).agg(*[e.alias(s) for s, e in sides.items()]).collect()
    for r in cells:
        corners.setdefault(r["feature"], []).append(r)
    boxes = {f: tuple(np.array([r[c] for r in rows], np.int64) for c in ("cell", *sides)) for f, rows in corners.items()}
    local = written(spread_out(placed, len(cells), *CELL).groupBy(*CELL).applyInPandas(_own_cell(k, boxes), LOCAL), "own-cells")
    opened = local.where(F.size("to") > 0)
    visits = opened.select(*POINT, "w", "bound", F.explode("to").alias("cell"))
    asked, copies = _in_parts(visits, placed, CELL, VISITS_PER_TASK, "px", "py")
    group = [*CELL, "_part"]
    asked, copies = (spread_out(side, len(cells), *group) for side in (asked, copies))
    remote = asked.groupBy(*group).cogroup(copies.groupBy(*group)).applyInPandas(_other_cell(k), REMOTE)
    found = opened.select(*POINT, "w", "d", "c").unionByName(remote)
    near = found.select(*POINT, "w", F.inline(F.arrays_zip("d", "c")))
    nearest = Window.partitionBy(*POINT).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_rows", F.sum("c").over(nearest)).where(F.col("_rows") >= k)
    radius = near.groupBy(*POINT, "w").agg(F.min("d").alias("radius"))
    closed = local.where((F.size("to") == 0) & (F.col("bound") >= 0))
    every = closed.select(*POINT, "w", F.col("bound").alias("radius")).unionByName(radius)
    return every.withColumn("feature", F.get(F.array(*[F.lit(f) for f in names]), F.col("feature")) if names else F.lit("").cast("string"))


# --- counts on one axis -------------------------------------------------------------------


ENDS = "feature int, px long, py long, w long, radius long, block int, low_block int, high_block int"
ASKED = ["feature", "block", "_part", "at", "w", "radius", "sign", "px", "py"]
INSIDE = "feature int, px long, py long, w long, inside long"


def _in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts in one block of values.

    Rows without a sign are values, whose radius, if it has one, ends in the block: how
    often each number of rows inside occurs. Rows with one are ends of radii from
    elsewhere: the signed number of values below the end, with values at a lower end.
    """
    sign, at, w, radius = (rows[c].to_numpy(np.int64) for c in ("sign", "at", "w", "radius"))
    value = np.flatnonzero(sign == 0)
    value = value[np.argsort(at[value], kind="stable")]
    values, below = at[value], np.r_[0, np.cumsum(w[value])]
    asks = value[radius[value] >= 0]
    low, high, some = at[asks] - radius[asks], at[asks] + radius[asks], radius[asks] > 0
    # without a radius, the rows at the value count
    upper = np.where(some, np.searchsorted(values, high, "left"), np.searchsorted(values, high, "right"))
    lower = np.where(some, np.searchsorted(values, low, "right"), np.searchsorted(values, low, "left"))
    inside, back = np.unique(below[upper] - below[lower], return_inverse=True)
    times = np.bincount(back, w[asks], len(inside)).astype(np.int64)
    ends = np.flatnonzero(sign)
    place = np.where(sign[ends] > 0, np.searchsorted(values, at[ends], "left"), np.searchsorted(values, at[ends], "right"))
    none = pd.array([pd.NA] * len(inside), "Int64")
    own = pd.DataFrame({"px": none, "py": none, "w": times, "inside": inside})
    far = pd.DataFrame({"px": pd.array(rows["px"].to_numpy()[ends], "Int64"), "py": pd.array(rows["py"].to_numpy()[ends], "Int64"),
                        "w": w[ends], "inside": sign[ends] * below[place]})
    return pd.concat([own, far], ignore_index=True).assign(feature=rows["feature"].iloc[0])


def rows_inside(points: DataFrame, axis: str) -> DataFrame:
    """(feature, inside, w): how many rows have so many rows nearer than their radius on one axis.

    At radius 0 the rows at the same value count. The point itself is included. Values
    are cut into blocks; a radius that ends in one block is counted there. For others
    the numbers of rows up to either end are subtracted: an end beside the values of
    its block is known from the blocks' sizes, another visits the block.
    """
    lowest = borders(points, ["feature"], axis, lambda n: n / BLOCK_ROWS)
    names = sorted(f for (f,) in lowest)

    def with_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, px, py, w, radius = numbered(batch, names, "px", "py", "w", "radius")
            at = px if axis == "px" else py
            blocks = np.zeros((3, len(at)), np.int32)
            for i in np.unique(feature):
                own = np.flatnonzero(feature == i)
                for block, ends in zip(blocks, (at[own], at[own] - radius[own], at[own] + radius[own])):
                    block[own] = np.searchsorted(lowest[(names[i],)], ends, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (feature, px, py, w, radius, *blocks)], ["feature", "px", "py", "w", "radius", "block", "low_block", "high_block"]
            )

    # read for the sizes of blocks, the values, and the radii that leave their block
    rows = written(points.select(*POINT, "w", "radius").mapInArrow(with_blocks, ENDS), "axis-ends").withColumn("at", F.col(axis))
    found = rows.groupBy("feature", "block").agg(F.sum("w").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    sizes = {(r["feature"], r["block"]): r for r in found}
    listed = []
    for i, name in enumerate(names):
        base = 0
        for block in range(len(lowest[(name,)]) + 1):
            own = sizes.get((i, block))
            listed.append((i, block, base, own["n"] if own else 0, own["lo"] if own else FAR, own["hi"] if own else -FAR))
            base += own["n"] if own else 0
    # at most PIECES blocks and values a feature
    kind = "feature int, block int, base long, n long, lo long, hi long"
    blocks = points.sparkSession.createDataFrame(listed, kind)

    def side(name: str) -> DataFrame:
        return F.broadcast(blocks.select("feature", *[F.col(c).alias(f"{name}_{c}") for c in ("block", "base", "n", "lo", "hi")]))

    low, high = F.col("at") - F.col("radius"), F.col("at") + F.col("radius")
    # rows below the higher end, and up to and with the lower one, that need no look into the block
    upper = F.when(high <= F.col("high_lo"), F.col("high_base")).when(high > F.col("high_hi"), F.col("high_base") + F.col("high_n"))
    lower = F.when(low < F.col("low_lo"), F.col("low_base")).when(low >= F.col("low_hi"), F.col("low_base") + F.col("low_n"))
    same = F.col("low_block") == F.col("high_block")
    # a radius that reaches into another block is above 0
    apart = rows.where(~same).join(side("low"), ["feature", "low_block"]).join(side("high"), ["feature", "high_block"])
    apart = written(apart.select("feature", "px", "py", "w", "low_block", "high_block", low.alias("low"), high.alias("high"),
                                 "low_base", "high_base", upper.alias("upper"), lower.alias("lower")), "axis-apart")
    # the known part of each; what is asked in blocks is added
    known = (F.coalesce("upper", "high_base") - F.coalesce("lower", "low_base")).alias("inside")
    settled = F.col("upper").isNotNull() & F.col("lower").isNotNull()

    def asks(name: str, sign: int) -> DataFrame:
        own = apart.where(F.col("upper" if sign > 0 else "lower").isNull())
        return own.select("feature", F.col(f"{name}_block").alias("block"), F.col(name).alias("at"), "w", F.lit(-1).cast("long").alias("radius"),
                          F.lit(sign).alias("sign"), "px", "py")

    ends = asks("high", 1).unionByName(asks("low", -1))
    # one row per block
    parts = F.broadcast(cut_lineage(ends.groupBy("feature", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_parts"))))
    pieces = F.coalesce("_parts", F.lit(1))
    asked = ends.join(parts, ["feature", "block"], "left").withColumn("_part", F.pmod(F.xxhash64("px", "py"), pieces).cast("int"))
    # values are read in each part of a block, their own radii in the first
    valued = rows.join(parts, ["feature", "block"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), pieces - 1)))
    own = F.when(same & (F.col("_part") == 0), F.col("radius")).otherwise(F.lit(-1))
    valued = valued.withColumn("radius", own).withColumn("sign", F.lit(0)).withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long"))
    group = ["feature", "block", "_part"]
    both = spread_out(valued.select(*ASKED).unionByName(asked.select(*ASKED)), len(listed), *group)
    counted = written(both.groupBy(*group).applyInPandas(_in_block, INSIDE), "axis-counts")
    whole = counted.where(F.col("px").isNull()).select("feature", "w", "inside")
    open_ = counted.where(F.col("px").isNotNull()).unionByName(apart.where(~settled).select(*POINT, "w", known))
    ranges = open_.groupBy(*POINT, "w").agg(F.sum("inside").alias("inside")).select("feature", "w", "inside")
    every = whole.unionByName(apart.where(settled).select("feature", "w", known)).unionByName(ranges).groupBy("feature", "inside").agg(F.sum("w").alias("w"))
    return every.withColumn("feature", F.get(F.array(*[F.lit(f) for f in names]), F.col("feature")) if names else F.lit("").cast("string"))


def nearest_mutual_information(long: DataFrame, neighbours: int = 3, cell_points: int = CELL_POINTS) -> DataFrame:
    """Mutual information of x and y per feature in nats, from (feature, x, y) rows without nulls.

    The estimator of Kraskov, Stoegbauer and Grassberger on all rows, with maximum
    distances of scaled values. Where ``neighbours`` or more other rows equal a
    point, the counts of equal rows take the place of the neighbour counts, as
    for mixtures of discrete and continuous values. Never below 0; 0 for features
    with at most ``neighbours`` rows and for constant ones.
    """
    points = written(weighted_points(long), "points")
    reached = written(neighbour_radius(points, neighbours, cell_points), "radii")
    joint = F.when(F.col("radius") > 0, F.lit(float(neighbours))).otherwise(F.col("w").cast("double"))
    total = reached.groupBy("feature").agg(F.sum("w").cast("double").alias("_n"), F.sum(digamma(joint) * F.col("w")).alias("_joint"))

    def margin(axis: str, name: str) -> DataFrame:
        return rows_inside(reached, axis).groupBy("feature").agg(F.sum(digamma(F.col("inside").cast("double")) * F.col("w")).alias(name))

    parts = total.join(margin("px", "_x"), "feature").join(margin("py", "_y"), "feature")
    value = digamma(F.col("_n")) + (F.col("_joint") - F.col("_x") - F.col("_y")) / F.col("_n")
    every = points.select("feature").distinct()
    return every.join(parts, "feature", "left").select("feature", F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias("mutual_info"))
