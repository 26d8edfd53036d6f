"""Components of the Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)])


def plain(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), low[root(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 5)
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(text))
                if rng.random() < 0.4:
                    text[at] = word()
                elif rng.random() < 0.5:
                    text[at:at] = [word() for _ in range(rng.randint(1, 4))]
                elif len(text) > 1:
                    del text[at]
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in text))
    passage = [word() for _ in range(40)]  # common to many documents, links few of them
    rows += [" ".join([word() for _ in range(rng.choice([2, 12, 40]))] + passage) for _ in range(40)]
    walk = [word() for _ in range(80)]  # a chain: each is similar to the next, the ends are not
    for _ in range(30):
        rows.append(" ".join(walk))
        walk = walk[3:] + [word() for _ in range(3)]
    rng.shuffle(rows)
    out = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    return out + [(2000, None), (2001, ""), (2002, " \n"), (2003, rows[0]), (2003, rows[0]), (2003, rows[1]), (2004, "one two"), (2005, "ONE  two")]


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 3), (3, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, c string").repartition(4)
    have = sorted(map(tuple, jaccard.join(docs, bits=16).collect()))
    assert have == plain(rows)
    assert len({r[2] for r in have}) < len(have) - 60


def test_prefixes_keep_every_pair():
    rng = np.random.default_rng(4)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(1, 80))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.r_[base[rng.random(len(base)) > 0.12], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)])
        shared = len(np.intersect1d(base, other))
        if not len(other) or 4 * shared < 3 * (len(base) + len(other) - shared):
            continue
        frequency = np.ones(1 << jaccard.FREQUENCY_BITS, np.int64)
        for s in (base, other):
            frequency[(s >> np.uint64(44)).astype(np.int64)] = rng.integers(1, 5000, len(s))
        (a, k), (b, m) = jaccard.prefix(base, frequency), jaccard.prefix(other, frequency)
        seen |= {k, m}
        assert len(np.intersect1d(a, b)) >= min(k, m)
    assert len(seen) > 1


def test_sets():
    texts = ["A b C d e f", "a b", "", None, "É b", "a b c d e", "x x x x x x x"]
    assert [len(s) for s in jaccard.shingle_sets(pa.array(texts, pa.string()))] == [len(plain_set(t)) for t in texts]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, jaccard.query(spark, folder).collect())) == plain(rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, jaccard.join(docs, bits=12).collect()))) == sorted(map(str, [(None, 2, None), (3, 2, 3), (5, 2, 3), (6, 0, 6)]))
    assert jaccard.join(docs.limit(0), bits=12).collect() == []
    kept = jaccard.stage(spark, docs.withColumn("_x", docs.doc_id), "")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "6", "None"] and kept.columns == ["doc_id", "text", "_x"]


def test_shared_passages_go_behind():
    """With the shared shingles behind, texts that only share a passage have none of it in their prefixes; similar ones still meet."""
    from panelark.llm.bitmap import Bitmap

    rng = np.random.default_rng(5)
    frequency = np.ones(1 << jaccard.FREQUENCY_BITS, np.int64)
    passage, own = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (40, 200))
    behind = Bitmap.none(26)
    at = passage >> np.uint64(64 - 26)
    np.bitwise_or.at(behind.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    text = np.unique(np.concatenate([passage, own]))
    head, _ = jaccard.prefix(text, frequency, behind)
    assert not np.isin(head, passage).any() and np.isin(jaccard.prefix(text, frequency)[0], passage).any()
    near = np.unique(np.concatenate([passage, own[:180], rng.integers(0, 1 << 64, 15, dtype=np.uint64)]))
    (a, k), (b, m) = jaccard.prefix(text, frequency, behind), jaccard.prefix(near, frequency, behind)
    assert len(np.intersect1d(a, b)) >= min(k, m)
