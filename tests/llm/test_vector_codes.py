import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from panelark.llm import vector_codes as vc


def plain(rows, rounds=vc.ROUNDS):
    """Rows (id, vector, label) coded one by one with Python's own integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = len(kept[0][1]) // 4
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(4)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        groups = [{} for _ in range(4)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p].setdefault(nearest(x, books[p])[1], []).append(x)
        for p, group in enumerate(groups):
            for k, xs in group.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    key = lambda r: (r[0] is None, r)
    return books, sorted(((i, code, error, by_label[lab], sha) for i, code, error, lab in out), key=key)


def coded(spark, rows, kind="long"):
    table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label int")
    return sorted((tuple(r) for r in vc.compress(table).collect()), key=lambda r: (r[0] is None, r))


def test_limb_products_are_exact():
    rng = random.Random(1)
    for width in (1, 2, 7, 16, 100):
        bound = vc.largest(width)
        for size in (3, 1 << 20, bound):
            a = np.array([[rng.choice([rng.randint(-size, size), size, -size, 0]) for _ in range(width)] for _ in range(9)], np.int64)
            b = np.array([[rng.choice([rng.randint(-size, size), size, -size]) for _ in range(width)] for _ in range(5)], np.int64)
            want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
            assert vc.dot(a, b).tolist() == want


def test_limbs_stay_in_range():
    values = np.array([[0, 1, -1, (1 << 40) + 5, -(1 << 40) - 5, (1 << 61)]], np.int64)
    for bits in (3, 17, 24):
        parts = vc.limbs(values, bits)
        assert all(np.abs(p).max() <= 1 << (bits - 1) for p in parts)
        assert sum(int(p[0, k]) << (bits * i) for i, p in enumerate(parts) for k in [3]) == (1 << 40) + 5
        assert [sum(int(p[0, k]) << (bits * i) for i, p in enumerate(parts)) for k in range(6)] == values[0].tolist()


def test_nearest_entry_with_ties_takes_the_lower_index():
    books = np.array([[[5], [1], [1], [3]]], np.int64)
    codes, errors = vc.assign(np.array([[1], [2], [4], [9]], np.int64), books)
    assert codes[:, 0].tolist() == [1, 1, 0, 0] and errors[:, 0].tolist() == [0, 1, 1, 16]


@pytest.mark.parametrize("width", [1, 3])
def test_against_plain_version(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4 * width)], rng.choice([None, 1, 2])) for i in range(330)]
    rows += [(7, rows[7][1], 1), (400, rows[3][1], None), (401, rows[3][1], 2), (-5, [-0.5] * 4 * width, 3)]
    bad = [(500, None, 1), (501, [None] + [0.0] * (4 * width - 1), 1), (502, [math.nan] * 4 * width, 1), (503, [math.inf] * 4 * width, 1), (504, [], 1)]
    rng.shuffle(rows)
    _, want = plain(rows)
    assert coded(spark, rows + bad) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(4e5, 5e5) for _ in range(8)], 0) for i in range(40)]
    _, want = plain(rows)
    assert coded(spark, rows) == want


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        coded(spark, [(1, [1e300] * 4, 0)])


def test_empty_and_few_rows(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    one = coded(spark, [(1, [0.5, -0.5, 0.25, 0.0], None)])
    assert [r[:4] for r in one] == [(1, "00000000", 0, 0)]


def test_null_ids_other_lengths_and_other_columns(spark):
    rows = [(None, [1.0] * 4, 1, "x", 1), (3, [2.0] * 4, 1, "y", 2), (4, [2.0] * 8, 1, "z", 3), (5, [1.0] * 3, 1, None, 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, vector int")
    out = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in vc.compress(table).collect())
    assert out == [(False, 3, "00000000", 0), (True, 0, "01010101", 0)]


def test_repeated_rows_are_coded_each(spark):
    out = coded(spark, [(1, [0.1] * 4, 1)] * 300 + [(2, [0.9] * 4, 2)])
    # entry 0 moves towards the other row, and the repeated one goes on to entry 1
    assert len(out) == 301 and {r[1] for r in out if r[0] == 1} == {"01010101"}
    assert out == plain([(1, [0.1] * 4, 1)] * 300 + [(2, [0.9] * 4, 2)])[1]


def test_decode_gives_the_entries_back(spark):
    books = np.arange(4 * 3 * 2, dtype=np.int64).reshape(4, 3, 2)
    got = vc.decode(spark.createDataFrame([("02000102",)], "code string"), books).first().vector
    assert got == [x / 1024 for x in [4, 5, 6, 7, 14, 15, 22, 23]]


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(duckdb.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in vc.query(spark, folder).collect()) == want
