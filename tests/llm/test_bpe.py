"""BPE: ids and decoded texts of the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelark.llm import bpe
from tests.llm.test_token_files import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def same(own, plain, texts):
    have, want = own.encode(texts), plain.encode_batch(texts, add_special_tokens=False)
    for text, ids, encoding in zip(texts, have, want, strict=True):
        assert ids.tolist() == encoding.ids, text
        assert own.decode(ids) == plain.decode(encoding.ids, skip_special_tokens=False)


def test_odd_texts(own, plain):
    same(own, plain, ODD)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(own, plain, texts):
    same(own, plain, texts)


def test_random_letters_and_every_token(own, plain):
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoin shrdluéñ.0122\n\"*-x") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    same(own, plain, texts + [b.decode("latin-1") for b in own.bytes_of[::7]])


def test_bytes_that_are_not_text(own, plain):
    for ids in ([5000, 128, 200], [188], [50256, 222, 11], []):
        assert own.decode(np.asarray(ids)) == plain.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(own, plain):
    tight = bpe.Bpe(PATH)
    tight.cache.limit = tight.words.limit = 2
    rng = random.Random(5)
    for _ in range(30):
        same(tight, plain, [" ".join(rng.choice(["tion", "the\nre", "x1y", "éé"]) * rng.randint(1, 3) for _ in range(9))])


def test_tables(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "none"), (90, None), (91, "b"), (91, "b"), (92, "long text, " * 20000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.digests(docs.limit(0), PATH).collect() == []
