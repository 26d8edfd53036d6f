"""Leaks in documents: exact, edited and paraphrased; the decomposition against numpy; recall of the search."""

import random

import numpy as np
import pyarrow as pa

from panelark.llm import decontamination as dec
from panelark.llm.words import words

FOLDER = "/root/testdata/sf0.01"


def corpus(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 90)))) for i in range(40)]
    docs, want = [], set()
    for d in range(300):
        text = [word() for _ in range(rng.randint(5, 300))]
        if d % 3 == 0:
            item, body = rng.choice(items)
            body = body.split()
            if d % 2:  # every fifth word is another one
                body = [word() if k % 5 == 2 else w for k, w in enumerate(body)]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in body] if d % 9 == 0 else body
            want.add((d, item))
        docs.append((d, " ".join(text)))
    return docs, items, want


def test_leaks_are_found_and_clean_documents_left_alone(spark, monkeypatch):
    docs, items, want = corpus()
    docs = docs + [(900, None), (901, ""), (902, " ".join(w for _, t in items[:1] for w in t.split()[:3])), (0, docs[0][1])]
    rows = spark.createDataFrame([(*r, 0.5, 1) for r in docs], "doc_id long, text string, cosine double, item_id int")
    bench = spark.createDataFrame(items + items[:2] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    have = dec.leaks(rows, bench).collect()
    assert {(r.doc_id, r.item_id) for r in have} == want
    assert len(have) == len(want) + 1
    monkeypatch.setattr(dec, "BLOCK", 16)
    assert {(r.doc_id, r.item_id) for r in dec.leaks(rows, bench).collect()} == want


def test_recall_of_the_latent_search(spark):
    """Against cosines of all passages and items without the latent space: at least 0.9 of those clearly above the threshold."""
    docs, items, _ = corpus(3)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    weight = dec.weights(*dec.passage_counts(rows.select("text")))
    for rank in (256, 24):
        space = dec.decompose(dec.segments(bench), weight, rank)
        near = found = 0
        for _, text in docs:
            h = words(pa.array([text])).hash
            for s in range(0, len(h), dec.HALF):
                own = h[s : s + 2 * dec.HALF]
                f, n = np.unique(dec.features(own), return_counts=True)
                full, length = dict(zip(f, n * weight[f])), np.sqrt((weight[dec.features(own)] ** 2).sum())
                latent = (weight[dec.features(own)][:, None] * space.rows(dec.features(own))).sum(0)
                for _, item in items:
                    g, m = np.unique(dec.features(words(pa.array([item])).hash), return_counts=True)
                    q = m * weight[g]
                    cosine = sum(full.get(k, 0) * v for k, v in zip(g, q)) / length / np.linalg.norm(q)
                    if cosine >= 0.3:
                        v = (q[:, None] * space.rows(g)).sum(0)
                        near += 1
                        found += latent @ v / length / max(np.linalg.norm(v), 1e-9) >= dec.MIN_COSINE
        assert near > 30 and found >= 0.9 * near


def test_decomposition_against_numpy(spark):
    _, items, _ = corpus(2)
    parts = dec.segments(spark.createDataFrame(items, "item_id long, text string")).repartition(4)
    weight = np.random.default_rng(1).uniform(0.5, 3, dec.FEATURES).astype(np.float32)
    space = dec.decompose(parts, weight, rank=20)
    a, distinct = dec._rows(pa.RecordBatch.from_pylist([{"hashes": bytes(r.hashes)} for r in parts.collect()]), weight)
    exact = np.linalg.svd(a, compute_uv=False)[:20]
    mine = space.rows(distinct)
    assert np.allclose(mine.T @ mine, np.eye(20), atol=1e-3)
    assert (np.linalg.norm(a @ mine) ** 2) > 0.97 * (exact**2).sum()


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 70))] for _ in range(2))
        mask = {}
        for i, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << i
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert dec.common_subsequence(mask, len(a), b) == row[-1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join("abcdefghijkl"))], "item_id long, text string")
    assert dec.leaks(docs, bench.limit(0)).collect() == [] and dec.leaks(docs.limit(0), bench).collect() == []


def test_given_documents(spark):
    """Items that a document holds word for word, whatever the case, are found; nothing is found in documents that share no five words with an item."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    have = {(r.doc_id, r.item_id) for r in dec.query(spark, FOLDER).collect()}
    lists = {i.item_id: i.text.lower().split() for i in items}
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in lists.items()}
    assert have
    for d in docs:
        own = d.text.lower().split()
        seen = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for i, w in lists.items():
            share = len(runs[i] & seen) / max(1, len(runs[i]))
            if share > 0.9:
                assert (d.doc_id, i) in have
            if share == 0:
                assert (d.doc_id, i) not in have
