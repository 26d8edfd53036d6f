"""Byte-level BPE, encoded by backtracking over longest token matches.

The merges of BPE give the one segmentation in which every pair of neighbours
is compatible: no merge that would come earlier crosses their border. The
encoder walks a word from the left with the longest token at each place and
steps back to a shorter one, or to the token before, when a pair is not
compatible. A place that was given up is never entered again, so a word of n
bytes takes at most n times the longest prefix chain steps.

Tables: an Aho-Corasick automaton of all tokens gives the longest token from
every byte; ``prefix`` the next shorter token that starts a token; ``split``
the two tokens that are merged to a token; verdicts on pairs are remembered.
Decoding gathers from one array of all tokens' bytes by an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelark.llm.common import bounded_batches, pick
from panelark.llm.pieces import SPECIAL, PieceCache
from panelark.llm.words import text_batches

# Fixed values of byte-level BPE: the pattern that cuts texts, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

MAX_PAIRS = 1 << 18  # remembered verdicts on pairs; more are worked out again


def byte_of() -> dict[str, int]:
    """The byte that each character of a token stands for: itself if shown, else numbered from 256."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, vocabulary: str):
        import ahocorasick

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_of()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        size = 1 + max(*model["vocab"].values(), *self.special.values())
        self.width = 2 if size <= 1 << 16 else 4

        self.bytes_of = [b""] * size
        for t, i in model["vocab"].items():
            self.bytes_of[i] = tokens.get(t, t.encode())
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.decimal = [str(i) for i in range(size)]

        # single bytes have no rank; a token's rank is that of the merge that makes it
        self.rank = [-1] * size
        self.split: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (model["vocab"][left], model["vocab"][right]), model["vocab"][left + right]
            self.merged[pair] = token
            if self.split[token] is None:
                self.split[token], self.rank[token] = pair, rank

        known = {b: model["vocab"][t] for t, b in tokens.items()}
        self.prefix: list[int | None] = [None] * size
        self.automaton = ahocorasick.Automaton()
        for b, i in known.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
            self.prefix[i] = next((known[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in known), None)
        self.automaton.make_automaton()
        self.known = known
        self.pairs: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.words = PieceCache(self._words)
        self.cache = PieceCache(self._pieces)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged together."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, latest first.

        At each moment of merging, the border has a token on either side. If
        those two can merge, by a rank before the merges that ended that moment,
        then merging would have crossed the border.
        """
        rank, split = self.rank, self.split
        until = len(self.merged) + 1  # merges from this rank on came after the moment
        a, b = left, right
        while True:
            token = self.merged.get((a, b))
            if token is not None and rank[token] < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # On equal ranks the left merge comes first, so the right one is undone first. A crossing merge
            # of the same rank as the left one's would start before it, and does not come later than it.
            if rank[a] > rank[b]:
                until, a = rank[a], split[a][1]
            else:
                until, b = rank[b] + 1, split[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word of the pattern."""
        if (whole := self.known.get(word)) is not None and self.whole(whole):
            return [whole]
        n = len(word)
        longest: list[int] = [0] * n
        for end, (size, token) in self.automaton.iter(word.decode("latin-1")):
            longest[end - size + 1] = token  # matches come by end, so the last one is the longest
        sizes, prefix, compatible = self.bytes_of, self.prefix, self.compatible
        open_at = bytearray(b"\1") * (n + 1)  # places not yet given up
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(sizes[token])
            if open_at[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return ids
                at, token = end, longest[end]
                continue
            shorter = prefix[token]
            while shorter is None:
                open_at[at] = 0
                token = ids.pop()
                at -= len(sizes[token])
                shorter = prefix[token]
            token = shorter

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019  one encoder lives as long as its worker
    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives that token, and not a dead end of other merges."""
        pair = self.split[token]
        if pair is None:
            return True
        return self.whole(pair[0]) and self.whole(pair[1]) and self.compatible_inside(*pair)

    def compatible_inside(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens before the merge of the two itself."""
        token = self.merged[(left, right)]
        rank, split = self.rank, self.split
        until, a, b = rank[token], left, right
        while True:
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until, a = rank[a], split[a][1]
            else:
                until, b = rank[b] + 1, split[b][0]
            crossing = self.merged.get((a, b))
            if crossing is not None and rank[crossing] < until:
                return False

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        return [self._pack(self.encode_word(w.encode())) for w in words]

    def _pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of pieces, by those of their words."""
        cut = [self.find(part) for part in parts]
        self.words.learn(set().union(*cut))
        get = self.words.young.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; a special token's string in a text is that token."""
        kind = f"<u{self.width}"
        if not any(SPECIAL in t for t in texts):
            return [np.frombuffer(p, kind) for p in self.cache.ids(texts)]
        end = self._pack([self.special[SPECIAL]])
        return [np.frombuffer(end.join(self.cache.ids(t.split(SPECIAL))), kind) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(start - before, size)
        return self.blob[place].tobytes().decode("utf-8", errors="replace")


_loaded: dict[str, Bpe] = {}


def loaded(vocabulary: str) -> Bpe:
    """The encoder of a worker process, made once."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Bpe(vocabulary)
    return _loaded[vocabulary]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids, an array<int>. Null text is empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in text_batches(batches):
            ids = bpe.encode(batch["text"].fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    picked = pick(docs, doc_id=id_col, text=text_col)
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: doc_id and text. Null ids are empty; ids outside the vocabulary fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.asarray(ids or [], np.int64)) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    bounded_batches(tokens.sparkSession)
    picked = pick(tokens, doc_id=id_col, ids=ids_col)
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids; its digests are those of the empty string.
    Rows are kept one by one, whatever their ids. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        name = bpe.decimal.__getitem__
        sha = hashlib.sha256
        for batch in text_batches(batches):
            encoded = bpe.encode(batch["text"].fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(ids) for ids in encoded], pa.int64()),
                    pa.array([sha(",".join(map(name, ids.tolist())).encode()).hexdigest() for ids in encoded]),
                    pa.array([sha(bpe.decode(ids).encode()).hexdigest() for ids in encoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded_batches(docs.sparkSession)
    picked = pick(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op6: digests of ids and of the decoded text of each document."""
    import public_tokenizers

    from panelark.llm.common import documents

    return digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
