"""The search of a cell leaf by leaf, and counts on one axis over several blocks."""

import numpy as np
import pandas as pd

from panelark.operators import neighbours


def test_a_cell_is_searched_by_leaves():
    rng = np.random.default_rng(4)
    x = np.where(rng.random(2000) < 0.5, 0, np.round(rng.standard_t(1, 2000), 2))
    points, w = np.unique((np.c_[x, np.round(rng.standard_t(2, 2000), 2)] * 1e9).astype(np.int64), axis=0, return_counts=True)
    leaves = neighbours.Leaves(*points.T, w)
    assert leaves.x.shape[1] < 2 * neighbours.LEAF_POINTS
    cell = pd.DataFrame({"feature": "a", "px": points[:, 0], "py": points[:, 1], "w": w, "cell": 0})
    low, high = points.min(axis=0), points.max(axis=0)
    out = neighbours._own_cell(3, {"a": tuple(np.array([v]) for v in (0, *low, *high))})(cell)
    assert not out["to"].map(len).any()
    every = np.repeat(points, w, axis=0)
    for px, py, bound in zip(out["px"], out["py"], out["bound"], strict=True):
        assert bound == np.sort(np.abs(every - [px, py]).max(axis=1))[3]  # the first is the point itself


def test_counts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [("f", int(v), i, int(r), 1 + i % 2) for i, (v, r) in enumerate(zip(rng.integers(-50, 50, 200), rng.integers(0, 40, 200)))]
    points = spark.createDataFrame(rows, "feature string, px long, py long, radius long, w long")
    have = {r["inside"]: r["w"] for r in neighbours.rows_inside(points, "px").collect()}
    want = {}
    for _, v, _, r, w in rows:
        n = sum(q[4] for q in rows if (abs(q[1] - v) < r if r else q[1] == v))
        want[n] = want.get(n, 0) + w
    assert have == want
