"""Token files: the tokenizer's own ids, offsets and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelark.llm import token_files
from panelark.llm.elias_fano import EliasFano
from panelark.llm.pieces import pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\nx", "it's 12 don't", " x 　 y", "tab\t x", "<|endoftext|>",
    "x <|endoftext|> y", "\x1c a\x1db \x85c", "日本 語", "é \U0001f600 ok", "a.\nB c", "\x00 a", "a" * 5000, " \t \r\n ",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_files.LibraryEncoder(PATH, 2)


def unpack(packed):
    return np.frombuffer(packed, "<u2").tolist()


def test_pieces_join_to_the_text():
    for text in ODD:
        assert " ".join(pieces(text)) == text


def test_ids_are_the_librarys(plain, encoder):
    have = [unpack(p) for p in encoder(ODD + ODD)]
    assert have == [plain.encode(t, add_special_tokens=False).ids for t in ODD + ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab'sé1.  \x1c語<|>")), max_size=30), min_size=1, max_size=4))
def test_ids_of_random_texts(plain, encoder, texts):
    assert [unpack(p) for p in encoder(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_cache_changes_nothing(plain):
    rng = random.Random(1)
    encoder = token_files.LibraryEncoder(PATH, 2)
    encoder.cache.limit = 3
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(20)) for _ in range(50)]
    for text in texts:
        assert unpack(encoder([text])[0]) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 10**9))
def test_elias_fano(values, more):
    values = sorted(values)
    code = EliasFano.build(np.asarray(values, np.int64), (values[-1] if values else 0) + more)
    assert code.values().tolist() == values
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def brute(rows, plain):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_against_brute_force(spark, plain, tmp_path):
    rows = [(i * 7 % 31, text) for i, text in enumerate(ODD)]
    rows += [(None, "no id"), (40, None), (41, "same"), (41, "same"), (41, "other"), (10**15, "far away " * 300)]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, start long, ids string")
    manifest = token_files.write(docs, PATH, f"file://{tmp_path}/files")
    crc = token_files.read(manifest, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint")
    have = sorted([tuple(r) for r in crc.collect()], key=lambda r: r[1])
    assert [(r[0], *r[1:]) for r in have] == brute(rows, plain)
    ids = {r.start: list(r.ids) for r in token_files.read(manifest).collect()}
    assert all(len(ids[s]) == n for _, s, n, _ in have)
    entry = manifest.orderBy("shard").first()
    with open(entry.path, "rb") as file:
        shard = token_files.Shard(file, (tmp_path / "files" / entry.path.rsplit("/", 1)[1]).stat().st_size)
        for i in range(shard.n_docs):
            assert shard.document(i).tolist() == ids[entry.base + int(shard.ends.select(i - 1) if i else 0)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(docs, PATH, str(tmp_path / "none"))).collect() == []
