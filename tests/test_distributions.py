"""Value counts as a frozen reference: mergeable, saved and loaded, and as exact as the rows."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from panelark.operators import drift
from panelark.plans import research
from panelark.sources.bundle import load_bundle, save_bundle

NAMES = ["a", "b", "gone"]


def frame(spark, n, seed, shift=0.0):
    rng = random.Random(seed)
    special = [None, math.nan, math.inf, -math.inf, 0.0, -0.0]
    value = lambda: rng.choice(special) if rng.random() < 0.1 else rng.gauss(shift, 1)
    rows = [(value(), float(rng.randint(0, 4)), None) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, gone double")


def plain(ref, cur):
    """PSI, KS and shifts of one feature from its rows."""
    zero = lambda s: s.replace([np.inf, -np.inf], np.nan).fillna(0.0)
    edges = np.linspace(zero(ref).min(), zero(ref).max(), 11)[1:-1]
    share = lambda s: np.maximum(np.bincount(np.searchsorted(edges, zero(s), "right"), minlength=10) / len(s), drift.EPSILON)
    e, a = share(ref), share(cur)
    x, y = (np.sort(s[np.isfinite(s)]) for s in (ref, cur))
    at = np.concatenate([x, y])
    ks = np.abs(np.searchsorted(x, at, "right") / max(len(x), 1) - np.searchsorted(y, at, "right") / max(len(y), 1)).max() if len(x) and len(y) else 0.0
    return ((a - e) * np.log(a / e)).sum(), ks, cur.isna().mean() - ref.isna().mean()


def test_measures_equal_those_of_the_rows(spark):
    ref, cur = frame(spark, 900, 1), frame(spark, 700, 2, 0.4)
    report = {r["feature"]: r for r in drift.drift_table(ref, cur, NAMES).collect()}
    p, q = ref.toPandas().astype(float), cur.toPandas().astype(float)
    for name in ("a", "b"):
        psi, ks, missing = plain(p[name], q[name])
        assert report[name]["ks_stat"] == pytest.approx(ks, abs=1e-12)
        assert report[name]["missing_ratio_change"] == pytest.approx(missing, abs=1e-12)
        assert report[name]["psi"] == pytest.approx(psi, abs=1e-9)
    assert report["b"]["mean_change"] == pytest.approx(q["b"].mean() - p["b"].mean())
    assert report["b"]["std_change"] == pytest.approx(q["b"].std() - p["b"].std())
    assert report["gone"]["psi"] == 0 and report["gone"]["ks_pvalue"] == 1


def test_parts_merge_into_the_whole(spark):
    parts = [frame(spark, n, n) for n in (5, 80, 1, 300)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    key = lambda df: sorted((r.feature, str(r.x), r.n) for r in df.collect())
    merged = drift.merge_counts(*[drift.value_counts(p, NAMES) for p in parts])
    assert key(merged) == key(drift.value_counts(whole, NAMES))


def test_empty_sides(spark):
    full, none = frame(spark, 50, 1), frame(spark, 50, 1).limit(0)
    for ref, cur in ((full, none), (none, full)):
        report = {r["feature"]: (r["psi"], r["ks_stat"], r["ks_pvalue"]) for r in drift.drift_table(ref, cur, ["a", "b"]).collect()}
        assert set(report.values()) <= {(0.0, 0.0, 1.0)}
    assert drift.drift_gate(full, none, ["a"]).first()["status"] == "SKIP"


def test_saved_reference_covers_all_labelled_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (dt.datetime(2024, 1, 1) + dt.timedelta(days=d), f"S{s}", 1.0, 1.0, 1.0, 1.0, 9.0, rng.gauss(d / 50, 1), rng.random(), None if d > 110 else rng.gauss(0, 1))
        for d in range(120) for s in range(60)
    ]
    df = spark.createDataFrame(
        rows, "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double,"
        " u double, v double, future_return_5d double",
    )
    save_bundle(research.train_model(df, ["u", "v"]), str(tmp_path / "b"))
    bundle = load_bundle(spark, str(tmp_path / "b"))
    labelled = df.dropna(subset=["future_return_5d"])
    assert bundle.reference.where("feature = 'u'").agg({"n": "sum"}).first()[0] == labelled.count() == 111 * 60
    out = research.score_universe(df, bundle, days=20)
    want = drift.drift_table(labelled, drift.evaluation_window(df, 20), ["u", "v"])
    a, b = (x.toPandas().sort_values("feature").reset_index(drop=True) for x in (out["drift"], want))
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert out["gate"].first()["current_rows"] == 20 * 60 and out["signals"].count() == 60
