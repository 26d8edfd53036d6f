"""Nearest-neighbour mutual information against a plain version over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelark.operators.neighbours import (
    UNITS,
    digamma,
    nearest_mutual_information,
    neighbour_radius,
    weighted_points,
)

SCHEMA = "feature string, x double, y double"


def psi(n):
    """Digamma of a whole number."""
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def scaled(values):
    spread = np.std(values)
    return np.zeros(len(values), np.int64) if spread == 0 else np.round(np.array(values) / spread * UNITS).astype(np.int64)


def plain(x, y, k=3):
    n = len(x)
    if n <= k:
        return 0.0, [], []
    px, py = scaled(x), scaled(y)
    dx, dy = np.abs(px[:, None] - px), np.abs(py[:, None] - py)
    apart = np.maximum(dx, dy)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    radius = np.sort(apart, axis=1)[:, k - 1]
    np.fill_diagonal(apart, 0)
    total = 0.0
    for i, r in enumerate(radius):
        inside = [(d[i] < r).sum() if r else (d[i] == 0).sum() for d in (dx, dy)]
        total += psi(k if r else (apart[i] == 0).sum()) - psi(inside[0]) - psi(inside[1])
    return max(0.0, psi(n) + total / n), list(zip(px, py)), radius


def made(n=400, seed=5):
    rng = random.Random(seed)
    y = [rng.gauss(0, 1) for _ in range(n)]
    flat = [0.0 if rng.random() < 0.4 else v for v in y]
    return {
        "linear": ([v + rng.gauss(0, 0.3) for v in y], y),
        "noise": ([rng.gauss(0, 5) for _ in y], y),
        "filled": ([0.0 if rng.random() < 0.5 else v for v in y], y),
        "flags": ([float(v > 0.5) for v in y], flat),
        "constant": ([1.0] * n, y),
        "heavy": ([math.exp(3 * v) for v in y], [math.exp(2 * rng.gauss(0, 1)) for _ in y]),
        "few": ([1.0, 2.0, 3.0], [1.0, 5.0, 2.0]),
        "repeated": ([float(i % 3) for i in range(n)], [float(i % 3) for i in range(n)]),
    }


def frame(spark, data):
    return spark.createDataFrame([(f, a, b) for f, (x, y) in data.items() for a, b in zip(x, y)], SCHEMA)


def test_digamma(spark):
    have = spark.range(1, 60).select(digamma(F.col("id").cast("double"))).collect()
    assert [r[0] for r in have] == pytest.approx([psi(n) for n in range(1, 60)], abs=1e-9)


@pytest.mark.parametrize("cell_points", [8, 1024])
def test_equals_all_pairs(spark, cell_points):
    data = made()
    rows = nearest_mutual_information(frame(spark, data), 3, cell_points).collect()
    have = {r["feature"]: r["mutual_info"] for r in rows}
    want = {f: plain(*xy)[0] for f, xy in data.items()}
    assert have == pytest.approx(want, abs=1e-8)
    assert have["linear"] > 1 > have["noise"] and have["few"] == 0


def test_radii_are_exact_over_many_cells(spark):
    data = {f: xy for f, xy in made(300, 8).items() if f in ("linear", "filled", "heavy", "flags")}
    rows = neighbour_radius(weighted_points(frame(spark, data)), 3, 5).collect()
    have = {(r["feature"], r["px"], r["py"]): r["radius"] for r in rows}
    want = {}
    for f, xy in data.items():
        _, points, radius = plain(*xy)
        want |= {(f, int(a), int(b)): int(r) for (a, b), r in zip(points, radius)}
    assert have == want


def test_hot_features_give_the_same(hot):
    data = made(250, 3)
    have = {r["feature"]: r["mutual_info"] for r in nearest_mutual_information(frame(hot, data), 3, 16).collect()}
    assert have == pytest.approx({f: plain(*xy)[0] for f, xy in data.items()}, abs=1e-8)


def test_empty_table(spark):
    assert nearest_mutual_information(frame(spark, {}), 3).collect() == []
