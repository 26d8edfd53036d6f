"""Benchmark passages in documents, also paraphrased: latent semantic search, then common subsequences and answers.

Benchmark items are cut to segments of at most SEGMENT words, in lower case. Words are hashed
to FEATURES classes and weighed by their inverse frequency among the passages
(of HALF words) of all documents. A randomised singular value decomposition of
the segments' TF-IDF rows, summed up over Spark tasks, gives the latent space.
Every document is read as overlapping passages of two halves; a passage is a
candidate for a segment by the cosine of the segment's latent vector and the
passage, whose length counts the part outside the latent space too.

A candidate is a leak if the longest common subsequence of the segment and the
words around the passage covers enough of the segment, and if enough of the
segment's answer, its rarest words, are there. Segments are searched in blocks, each against
all documents, so what tasks get is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, documents, pick, saved
from panelark.llm.words import text_batches, words

FEATURE_BITS = 17
FEATURES = 1 << FEATURE_BITS
HALF = 24  # words from one passage to the next; a passage has twice as many
SEGMENT = 64
RANK, EXTRA = 256, 16  # dimensions kept, and more while they are found
POWER = 1  # rounds that sharpen the decomposition
BLOCK = 4096  # segments, about, that are searched in one pass
TOKENS_AT_ONCE = 2048  # whose vectors are gathered at once, so that they stay in the processor's cache
MIN_COSINE = 0.15
MIN_SUBSEQUENCE = 0.5  # share of a segment's words
ANSWER_PART, MIN_ANSWER = 0.5, 0.5  # the rarest part of a segment's different words, and the share of them that must be there
MIN_WORDS = 8  # of a segment; fewer words say nothing


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def halves(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the half passage of each word; halves start anew with each text."""
    n = np.diff(first)
    before = np.concatenate([[0], np.cumsum(-(-n // HALF))])
    place = np.arange(len(doc)) - first[doc]
    return before[doc] + place // HALF


def passage_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of half passages of all documents that have each feature, and of all; at most FEATURES numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(FEATURES, np.int64), 0
        for batch in text_batches(batches):
            found = words(pc.utf8_lower(batch["text"]))
            half = halves(found.doc, found.first)
            total += int(half[-1]) + 1 if len(half) else 0
            counts += np.bincount(np.unique(half * FEATURES + features(found.hash)) % FEATURES, minlength=FEATURES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[counts[at], total])], ["f", "n"])

    out, total = np.zeros(FEATURES, np.int64), 0
    for r in docs.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            total = r["n"]
        else:
            out[r["f"]] = r["n"]
    return out, total


def weights(counts: np.ndarray, total: int) -> np.ndarray:
    return np.log((total + 2) / (counts + 1)).astype(np.float32)


def segments(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, part, hashes): the items' words in runs of at most SEGMENT; short runs and null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = words(pc.utf8_lower(batch["text"]))
            first = found.first
            item, part, hashes = [], [], []
            for i in range(batch.num_rows):
                n = int(first[i + 1] - first[i])
                pieces = max(1, -(-n // SEGMENT))
                for k, own in enumerate(np.array_split(found.hash[first[i] : first[i + 1]], pieces)):
                    if len(own) >= MIN_WORDS:
                        item.append(i)
                        part.append(k)
                        hashes.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["item"].take(pa.array(item, pa.int64())), pa.array(part, pa.int32()), pa.array(hashes, pa.binary())], ["item", "part", "hashes"]
            )

    rows = pick(benchmark, item=id_col, text=text_col)
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, part int, hashes binary")


def _rows(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length: row, feature and value of the cells, and the distinct features."""
    hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch["hashes"]]
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    cell, n = np.unique(row * FEATURES + features(np.concatenate(hashes)), return_counts=True)
    row, feature = cell // FEATURES, cell % FEATURES
    value = n * weight[feature]
    norm = np.sqrt(np.bincount(row, value**2, len(hashes)))
    value = value / np.maximum(norm, 1e-9)[row]
    distinct, at = np.unique(feature, return_inverse=True)
    matrix = np.zeros((len(hashes), len(distinct)), np.float32)
    matrix[row, at] = value
    return matrix, distinct


ROWS_AT_ONCE = 256


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


class Space(NamedTuple):
    """Latent space: place of each feature (-1 outside), weights of features, and one vector a place."""

    place: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray

    def rows(self, feature: np.ndarray) -> np.ndarray:
        return self.vectors[self.place[feature]]


def decompose(parts: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 5) -> Space:
    """Right singular vectors of the segments' TF-IDF rows A by a randomised range finder.

    Each round sums A'(A M) over all tasks, for the last round's M; the first M
    is random. M has one row of rank + EXTRA numbers for each feature that the
    segments have, at most FEATURES; that bounds what tasks and driver exchange.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_rows(batch, weight)[1])], ["f"])

    known = np.sort([r["f"] for r in parts.mapInArrow(own, "f bigint").distinct().collect()]).astype(np.int64)
    if not len(known):
        return Space(np.full(FEATURES, -1), weight, np.zeros((1, rank), np.float32))
    place = np.full(FEATURES, -1)
    place[known] = np.arange(len(known))

    def product(matrix: np.ndarray) -> np.ndarray:
        width = matrix.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(matrix)
            seen = np.zeros(len(matrix), bool)
            for batch in _small(batches):
                a, distinct = _rows(batch, weight)
                total[place[distinct]] += a.T @ (a @ matrix[place[distinct]])
                seen[place[distinct]] = True
            at = np.flatnonzero(seen)
            f = np.repeat(at, width)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.tile(np.arange(width), len(at))), pa.array(total[at].astype(float).ravel())], ["f", "j", "v"])

        table = parts.mapInArrow(run, "f bigint, j bigint, v double").groupBy("f", "j").agg(F.sum("v").alias("v")).toArrow()
        f, j, v = (table[c].to_numpy() for c in "fjv")
        out = np.zeros(matrix.shape)
        out[f, j] = v
        return out

    basis = np.random.default_rng(seed).normal(size=(len(known), rank + EXTRA)).astype(np.float32)
    for _ in range(1 + POWER):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    image = product(basis)  # A'A times the basis
    values, turn = np.linalg.eigh(basis.T @ image)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-6]
    vectors = (basis @ turn[:, keep]).astype(np.float32)
    return Space(place, weight, np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)]))  # place -1 is the last row


class Block(NamedTuple):
    """Segments searched at once: items, words, latent unit vectors and answers."""

    items: list
    words: list[np.ndarray]
    vectors: np.ndarray
    answers: list[np.ndarray]
    masks: list[dict[int, int]]


def _block(rows: list, space: Space) -> Block:
    hashes = [np.frombuffer(bytes(r["hashes"]), np.uint64) for r in rows]
    vectors = np.stack([(space.weight[features(h)][:, None] * space.rows(features(h))).sum(0) for h in hashes])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    answers, masks = [], []
    for h in hashes:
        distinct = np.unique(h)
        answers.append(distinct[np.argsort(-space.weight[features(distinct)], kind="stable")[: int(np.ceil(ANSWER_PART * len(distinct)))]])
        mask: dict[int, int] = {}
        for i, w in enumerate(h.tolist()):
            mask[w] = mask.get(w, 0) | 1 << i
        masks.append(mask)
    return Block([r["item"] for r in rows], hashes, vectors.astype(np.float32), answers, masks)


def common_subsequence(mask: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``mask`` has the places of each word."""
    full = (1 << size) - 1
    row = full
    for word in other:
        if hit := mask.get(word):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def _search(space: Space, block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.flatnonzero(space.place >= 0)
        weighed = space.vectors.copy()
        weighed[space.place[known]] *= space.weight[known][:, None]
        for batch in text_batches(batches):
            found = words(pc.utf8_lower(batch["text"]))
            if not len(found.hash):
                continue
            first = found.first
            feature = features(found.hash)
            half = halves(found.doc, first)
            n = int(half[-1]) + 1
            weight = space.weight[feature]
            square = np.bincount(half, weight.astype(float) ** 2, n)
            inside = np.flatnonzero(space.place[feature] >= 0)
            latent = np.zeros((n, space.vectors.shape[1]), np.float32)
            for i in range(0, len(inside), TOKENS_AT_ONCE):
                own = inside[i : i + TOKENS_AT_ONCE]
                start = np.flatnonzero(np.r_[True, half[own][1:] != half[own][:-1]])
                latent[half[own[start]]] += np.add.reduceat(weighed[space.place[feature[own]]], start)
            score = latent @ block.vectors.T
            text_of = np.zeros(n, np.int64)
            text_of[half] = found.doc
            pair = np.r_[text_of[1:] == text_of[:-1], False]  # a passage is a half and the next one of the same text
            after = np.minimum(np.arange(n) + 1, n - 1)
            cosine = (score + np.where(pair, 1, 0)[:, None] * score[after]) / np.sqrt(square + np.where(pair, square[after], 0) + 1e-9)[:, None]
            best: dict[tuple, tuple] = {}
            words_of = found.hash.tolist() if (hits := np.argwhere(cosine >= MIN_COSINE)).size else []
            start_of = np.searchsorted(half, np.arange(n))
            for h, s in hits.tolist():
                size = len(block.words[s])
                doc = int(text_of[h])
                low = max(int(first[doc]), int(start_of[h]) - size)
                high = min(int(first[doc + 1]), int(start_of[h]) + 2 * HALF + size)
                around = words_of[low:high]
                share = common_subsequence(block.masks[s], size, around) / size
                if share < MIN_SUBSEQUENCE:
                    continue
                present = set(around)
                answer = sum(w in present for w in block.answers[s].tolist()) / len(block.answers[s])
                if answer >= MIN_ANSWER:
                    key = (doc, block.items[s])
                    best[key] = max(best.get(key, (0, 0, 0)), (share, answer, float(cosine[h, s])))
            if best:
                docs = batch["doc_id"].take(pa.array([d for d, _ in best]))
                share, answer, cosines = (pa.array([v[i] for v in best.values()], pa.float64()) for i in range(3))
                yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in best]), cosines, share, answer], ["doc_id", "item_id", "cosine", "subsequence", "answer"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each document and benchmark item that is found in it: doc_id, item_id, cosine, subsequence, answer.

    Clean documents have no row. Whole texts are searched. Null and empty texts
    and items with fewer than MIN_WORDS words match nothing; an item in several
    segments is found by its best one. A repeated row of ``docs`` is found each time; repeated items once.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    parts = saved(segments(benchmark, item_col, item_text_col).distinct(), "segments")
    kind, item = (s.dataType.simpleString() for s in (rows.schema["doc_id"], parts.schema["item"]))
    schema = f"doc_id {kind}, item_id {item}, cosine double, subsequence double, answer double"
    total = parts.count()
    if not total:
        return spark.createDataFrame([], schema)
    space = decompose(parts, weights(*passage_counts(rows.select("text"))))
    blocks = -(-total // BLOCK)
    found = None
    for b in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == b).orderBy("item", "part", "hashes").collect()
        if own:
            hits = rows.mapInArrow(_search(space, _block(own, space)), schema)
            found = hits if found is None else found.unionByName(hits)
    if blocks == 1:
        return found
    # parts of one item may be in several blocks; a row of the documents then has one row for each
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "subsequence", "answer")])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op3: leaks of all benchmark items in all documents."""
    return leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline: documents with a leak go. Rows without an id are matched by their text alone and go with it."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    marked = docs.withColumn("_key", key)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    gone = saved(leaks(marked, benchmark, id_col="_key").select("doc_id").distinct(), "leaks")
    return marked.join(gone, marked["_key"] == gone["doc_id"], "left_anti").select(*docs.columns)
