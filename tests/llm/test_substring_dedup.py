"""Words removed, against a plain scan of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelark.llm import substring_dedup as dedup
from panelark.llm.bitmap import Bitmap, collect_bitmap

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    first = {}
    for doc_id, text in rows:
        found = WORD.findall(text or "")
        if doc_id is not None:
            for i in range(len(found) - window + 1):
                key = tuple(found[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        found = WORD.findall(text or "")
        gone = set()
        if doc_id is not None:
            for i in range(len(found) - window + 1):
                if first[tuple(found[i : i + window])] < doc_id:
                    gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((doc_id, len(found), len(gone), kept))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 4)
    passages = [[word() for _ in range(rng.randint(window - 2, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [word() for _ in range(rng.randint(0, 3 * window))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(parts))
            parts[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((i * 3 % 91, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200 + k, rows[5][1]) for k in range(5)] + [(300 + k, rows[7][1] + f" x{k}") for k in range(5)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, rows[5][1]), (None, None), (12, rows[5][1]), (12, rows[5][1]), (403, "z " * 400), (404, "z " * 30)]
    return rows


@pytest.mark.parametrize("window, base", [(13, 7), (5, 2), (20, 3)])
def test_against_all_windows(spark, window, base):
    rows = corpus(window, window)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, a string, place int")
    have = dedup.dedup(docs, window, base, bits=16)
    assert sorted(map(tuple, have.collect()), key=str) == plain(rows, window)
    assert sum(r[2] for r in plain(rows, window)) > 500


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, 13)]
    assert sorted(map(tuple, dedup.query(spark, folder).collect()), key=str) == sorted(want, key=str)


def test_nothing_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50))), (2, "other words")], "doc_id long, text string")
    assert [r.n_removed for r in dedup.dedup(docs, bits=12).collect()] == [0, 0]
    assert dedup.dedup(docs.limit(0), bits=12).collect() == []


def test_bitmap_misses_nothing(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    table = collect_bitmap(spark.createDataFrame([(int(h),) for h in hashes], "a long"), 16)
    assert table.has(hashes.view(np.uint64)).all()
    assert table.has(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.12
    assert collect_bitmap(spark.createDataFrame([], "a long"), 16).empty


def test_levels():
    assert dedup.levels(7, 13) == [7, 13] and dedup.levels(3, 20) == [3, 6, 12, 20] and dedup.levels(30, 13) == [13]


def test_windows_are_counted_once_a_row():
    """Below the last level only hashes are shuffled, and a row that repeats its own window counts once."""
    texts = ["a b c d e f g h i j k l m " * 3, "one two"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "_h": [1, 2], "t": [0, 0], "text": texts})
    emit = dedup._windows([7, 13], [], 13, False, Bitmap.none(12))
    out = list(emit(iter([batch])))
    assert [b.schema.names for b in out] == [["a"]] * len(out)
    seen = [a for b in out for a in b["a"].to_pylist()]
    assert seen and len(seen) == len(set(seen))
