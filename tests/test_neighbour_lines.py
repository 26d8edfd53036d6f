"""Cells with many points of one value, and equal points in several rows."""

import numpy as np
import pandas as pd

from panelark.operators import neighbours


def cell(px, py, w=None):
    return pd.DataFrame({"feature": "a", "px": px, "py": py, "w": 1 if w is None else w, "cell": 0})


def searched(rows, k=3):
    far = neighbours.FAR
    return neighbours._own_cell(k, {"a": tuple(np.array([v]) for v in (0, -far, -far, far, far))})(rows)


def test_a_query_meets_only_leaves_near_it_on_a_line():
    rng = np.random.default_rng(6)
    n = 20_000
    # half of the points share an x: their strips are one run of leaves, not overlapping boxes
    leaves = neighbours.Leaves(np.where(np.arange(n) % 2, 0, rng.integers(-(10**8), 10**8, n)), rng.integers(-(10**9), 10**9, n), np.ones(n, np.int64))
    query, _ = leaves.met(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 1000), np.arange(1))
    assert 1 <= len(query) <= 4


def test_equal_points_in_several_rows_are_one():
    out = searched(cell([5, 0, 5, 9, 0, 5], [1, 0, 1, 2, 0, 1], [1, 2, 1, 1, 1, 2]))
    assert sorted(zip(out["px"], out["py"], out["w"], out["bound"])) == [(0, 0, 3, 5), (5, 1, 4, 0), (9, 2, 1, 4)]


def test_leaves_of_a_tall_cell_are_not_thin():
    rng = np.random.default_rng(8)
    n = 20_000
    leaves = neighbours.Leaves(rng.integers(0, 10**5, n), rng.integers(0, 10**8, n), np.ones(n, np.int64))
    assert np.median(leaves.high[1] - leaves.low[1]) < 20 * np.median(leaves.high[0] - leaves.low[0])


def test_lines_equal_all_pairs():
    rng = np.random.default_rng(7)
    at = np.unique(rng.integers(-500, 500, 300))
    for px, py in ((np.full(len(at), 4), at), (at, np.full(len(at), -2)), (np.repeat(at, 2)[:301], np.arange(301) * 7 % 311)):
        out = searched(cell(px, py))
        apart = np.maximum(np.abs(px[:, None] - px), np.abs(py[:, None] - py))
        want = dict(zip(zip(px, py), np.sort(apart, axis=1)[:, 3]))
        assert {(a, b): r for a, b, r in zip(out["px"], out["py"], out["bound"])} == want
