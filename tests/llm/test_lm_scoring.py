"""Word counts and base scores against plain Python; the model's normalisation, gradients and gain on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelark.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
tokens = lambda text: [*WORD.findall((text or "").translate(LOWER)), None]


def plain(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((i, held(i), len(own), sum(c[t] > 0 for t in own), n, base))
    return sorted(out, key=lambda r: (str(r[0]), r[2], r[5]))


def agree(have, rows):
    have = sorted(map(tuple, have), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(have) == len(rows)
    for r, want in zip(have, plain(rows), strict=True):
        assert r[:5] == want[:5] and r[5] == pytest.approx(want[5], rel=1e-9) and r[6] < 0


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT_BITS", 8)  # so that most words are joined
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    have = lm.query(spark, folder).collect()
    agree(have, rows)
    held = [r for r in have if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, "The cat  the CAT"), (2, None), (3, ""), (4, "dog"), (4, "dog"), (None, "the end"), (5, "the " * 30000 + "É"), (20, "cat"), (33, "new word")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, row int")
    training = docs.where(lm.fold("doc_id", 10) != 0)
    out = lm.score(docs, training).withColumn("held_out", lm.fold("doc_id", 10) == 0)
    agree(out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), rows)
    alone = lm.score(docs, docs.limit(0)).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)} and all(np.isfinite(r.score) for r in alone)
    assert lm.score(docs.limit(0), docs).collect() == []


def toy():
    share = np.array([0.4, 0.1, 0.3, 0.2])
    return lm.Model.start(share), share


def test_probabilities_are_normalised():
    model, _ = toy()
    p = 10 ** model.log10_probabilities(np.array([[0, 1], [2, 3], [1, 1]])).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_training_finds_a_pattern(monkeypatch):
    monkeypatch.setattr(lm, "STEP", 64)
    rng = random.Random(1)
    kinds = [2]
    while len(kinds) < 20000:  # 3 follows 2 most of the time
        kinds.append(3 if kinds[-1] == 2 and rng.random() < 0.9 else rng.choice([0, 1, 2]))
    kind = np.array(kinds[2:])
    before = np.stack([kinds[1:-1], kinds[:-2]], axis=1)
    share = np.bincount(kind, minlength=4) / len(kind)
    model = lm.Model.start(share)
    trainer = lm.Trainer(model, share, 1)
    for _ in range(200):
        trainer.learn(before, kind)
    mean = lambda m: m.log10_probabilities(before)[np.arange(len(kind)), kind].mean()
    # the entropy of the pattern bounds what can be reached
    assert mean(trainer.model) > mean(model) + 0.1


def test_words_beyond_any_fixed_vocabulary_gain(spark):
    """2,000 equally frequent words in two sets that never mix: the word before decides the half, whichever word it is; so do the last letters of rare ones."""
    rng = random.Random(3)
    sets = [[f"{p}{i}{p}" for i in range(1000)] for p in ("lo", "ke")]
    rows = [(i, " ".join(rng.choices(sets[i % 2], k=60) + [f"{i}x{rng.randrange(10**9)}{('lo', 'ke')[i % 2]}"])) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    training = docs.where(lm.fold("doc_id", 10) != 0)
    known, _ = lm.vocabulary(lm.count_words(training.select("text")))
    assert len(known.hashes) == 2001
    gain = {}
    for rounds in (1, 4):
        held = [r for r in lm.score(docs, training, rounds=rounds).collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
        gain[rounds] = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain[4] > max(0.05, gain[1])  # at most log10(2) = 0.30


def test_scores_are_above_the_base(spark):
    held = [r for r in lm.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
