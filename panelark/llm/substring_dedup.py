"""Removal of words in passages that an earlier document has, by level-wise doubling.

A stretch of ``window`` words can only repeat if all shorter windows in it
repeat. The levels are ``base``, 2 x base, ... and at last ``window`` words.
On a level below the last, of every stretch of ``window`` words only the window
with the smallest hash is looked at (a minimizer; equal stretches have it at
the same place), and the stretches whose minimizer repeats go on to the next
level with windows of twice the length. It ends when no stretch is left, or on
the last level, where every window left is compared.

Which windows repeat is a sum of partial counts of rows, on the last level of
partial minima and maxima of document ids, so a window in a third of all
documents costs no more than any other. What goes on
from one level to the next is a bitmap of fixed size: a false hit only sends a
stretch on that the next level sorts out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.llm.bitmap import Bitmap, collect_bitmap, only
from panelark.llm.common import bounded_batches, documents, pick, saved
from panelark.llm.words import Words, grams, text_batches, words

WINDOW = 13
BASE = 7
BITS = 26


def levels(base: int, window: int) -> list[int]:
    """Lengths of the windows on each level; the last is ``window``."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def minimizers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of each ``span`` neighbouring hashes, the leftmost on ties."""
    if span == 1:
        return np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return view.argmin(axis=1) + np.arange(len(view))


class Stretches:
    """Words of a batch of texts, and the starts of the stretches of ``window`` words that may still repeat."""

    def __init__(self, texts: pa.Array, window: int):
        self.words: Words = words(texts)
        self.window = window
        self.first = self.words.first
        doc = self.words.doc
        n = max(0, len(doc) - window + 1)
        self.live = doc[:n] == doc[window - 1 :] if n else np.zeros(0, bool)

    def chosen(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the live stretches, and the place in each of the window of this level that stands for it."""
        start = np.flatnonzero(self.live)
        if not len(start):
            return start, start
        hashes = grams(self.words.hash, length)
        place = np.empty(len(start), np.int64)
        cut = np.flatnonzero(np.diff(start) > 1) + 1  # runs of neighbouring stretches
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(start)], strict=True):
            s, e = int(start[i]), int(start[j - 1]) + self.window
            place[i:j] = s + minimizers(hashes[s : e - length + 1], self.window - length + 1)
        return start, place

    def narrow(self, length: int, repeated: Bitmap) -> None:
        """Keep the stretches whose window of a level repeats."""
        start, place = self.chosen(length)
        self.live[start] = repeated.has(grams(self.words.hash, length)[place]) if len(start) else False


def _windows(lengths: list[int], filters: list[Bitmap], window: int, with_place: bool, skip: Bitmap):
    """Emits (a), once a row, or (a, b, doc_id, t, place) of the level after the given filters; b is 32 bits of a second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(only(batches, "_h", outside=skip)):
            stretches = Stretches(batch["text"], window)
            for length, repeated in zip(lengths, filters):
                stretches.narrow(length, repeated)
            length = lengths[len(filters)]
            place = np.unique(stretches.chosen(length)[1])
            a, doc = grams(stretches.words.hash, length)[place], stretches.words.doc[place]
            if not with_place:
                order = np.lexsort((a, doc))
                a, doc = a[order], doc[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])][: len(a)]
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[new].view(np.int64))})
                continue
            b = grams(stretches.words.hash, length, 1)[place]
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(a.view(np.int64)),
                    "b": pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    "doc_id": batch["doc_id"].take(pa.array(doc)),
                    "t": batch["t"].take(pa.array(doc)),
                    "place": pa.array((place - stretches.first[doc]).astype(np.int32)),
                }
            )

    return run


def _kept(window: int, skip: Bitmap | None = None, skip_too: Bitmap | None = None):
    """Words left after the windows at ``places`` are taken out; [-1] stands for all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(only(only(batches, "_h", outside=skip), "_h", outside=skip_too)):
            found = words(batch["text"])
            first = found.first
            n = np.diff(first)
            removed = np.zeros(len(n), np.int64)
            texts = []
            for i, places in enumerate(batch["places"]):
                start, end = found.start[first[i] : first[i + 1]], found.end[first[i] : first[i + 1]]
                if places.is_valid:
                    at = places.values.to_numpy()
                    if at[0] < 0:
                        at = np.arange(n[i] - window + 1)
                    edge = np.zeros(n[i] + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed[i] = gone.sum()
                    start, end = start[~gone], end[~gone]
                base = int(found.offsets[i])
                raw = found.data[base : found.offsets[i + 1]].tobytes()
                texts.append(b" ".join([raw[s:e] for s, e in zip((start - base).tolist(), (end - base).tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n.astype(np.int64)), pa.array(removed), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def repeated_windows(docs: DataFrame, spared: DataFrame, skip: Bitmap, window: int = WINDOW, base: int = BASE, bits: int = BITS) -> DataFrame:
    """(doc_id, t, places): the windows of each row whose words also start a window in a document with a smaller id.

    ``docs`` has doc_id (no nulls), its hash ``_h``, text and ``t``, a hash of the
    text that tells rows with one id apart. Rows in the bitmap ``skip`` are left
    out, but for those in ``spared``. Rows without such a window have none.
    """
    lengths, filters = levels(base, window), []
    kind = docs.schema["doc_id"].dataType.simpleString()

    def level(with_place: bool, schema: str) -> DataFrame:
        each = [(docs, skip), (spared, Bitmap.none(skip.bits))]
        one, two = (part.mapInArrow(_windows(lengths, list(filters), window, with_place, left_out), schema) for part, left_out in each)
        return one.unionByName(two)

    for _ in lengths[:-1]:
        # rows, not ids, are counted: rows that share an id only go on to the next level
        repeated = collect_bitmap(level(False, "a bigint").groupBy("a").count().where("count > 1").select("a"), bits)
        if repeated.empty:
            none = T.StructType([docs.schema["doc_id"], docs.schema["t"], T.StructField("places", T.ArrayType(T.IntegerType()))])
            return docs.sparkSession.createDataFrame([], none)
        filters.append(repeated)
    # read twice: the windows take more room on disk than time to make again
    last = level(True, f"a bigint, b int, doc_id {kind}, t int, place int")
    first = last.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    later = last.join(first.select("a", "b", "low"), ["a", "b"]).where("doc_id > low")
    return later.groupBy("doc_id", "t").agg(F.collect_list("place").alias("places"))  # at most a text's windows


def dedup(
    docs: DataFrame, window: int = WINDOW, base: int = BASE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and ``kept``, the words left, joined by single spaces.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Null and empty
    texts have no words. Rows with one id count as one document when ids are
    compared, so they don't remove each other's words, and rows without an id
    neither lose words nor take any. Windows are compared by 96-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns({"_h": F.xxhash64("doc_id"), "t": F.hash("text")})
    # whole copies of an earlier text: nothing is left of them, and they need not be compared
    texts = rows.where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    lowest = texts.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = saved(texts.join(lowest, "sha").where("doc_id > low").select("doc_id", "sha").distinct(), "copies")
    copied_ids = collect_bitmap(copies.select(F.xxhash64("doc_id").alias("a")), bits)
    maybe = rows.mapInArrow(lambda batches: only(batches, "_h", inside=copied_ids), rows.schema).withColumn("sha", F.sha2("text", 256))
    spared = saved(maybe.join(copies, ["doc_id", "sha"], "left_anti").select(rows.columns), "spared")  # rows that only share a bit with a copy
    copied = maybe.join(copies, ["doc_id", "sha"], "left_semi")

    compared = [r.where("doc_id is not null") for r in (rows, spared)]
    places = saved(repeated_windows(*compared, copied_ids, window, base, bits), "places")
    # only documents that may lose words are shuffled; the others are done where they are read
    hit = collect_bitmap(places.select(F.xxhash64("doc_id").alias("a")), bits)
    none, everywhere = F.lit(None).cast("array<int>").alias("places"), F.array(F.lit(-1)).alias("places")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"
    chosen = rows.mapInArrow(lambda batches: only(only(batches, "_h", outside=copied_ids), "_h", inside=hit), rows.schema).unionByName(spared)
    parts = [
        chosen.join(places, ["doc_id", "t"], "left").select(*rows.columns, "places").mapInArrow(_kept(window), schema),
        rows.select("*", none).mapInArrow(_kept(window, copied_ids, hit), schema),
        copied.select(*rows.columns, everywhere).mapInArrow(_kept(window), schema),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op1: words left of every document, as a digest."""
    out = dedup(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
