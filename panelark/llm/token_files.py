"""Token-id files with Elias-Fano document boundaries.

One file per range of document ids. Layout, little-endian:

    ids        n_ids x width bytes, the documents' ids one after the other
    doc_ids    n_docs x int64
    null       n_docs bytes, 1 where the document has no id
    low, high  Elias-Fano code of the documents' ends within the file
    samples    uint64, the select structure
    footer     JSON with the sizes, then its length as uint32, then MAGIC

Documents are in ascending id order within and across files. ``write`` returns
a manifest, one row per file, with the number of ids before it, so that the
global offset of a document is the file's base plus a select in the file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, pick, saved
from panelark.llm.elias_fano import EliasFano
from panelark.llm.pieces import SPECIAL, PieceCache
from panelark.llm.words import text_batches
from panelark.session import scratch_path

MAGIC = b"EFTOKEN1"
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"


class LibraryEncoder:
    """Ids by the tokenizers library; whole pieces are encoded together and remembered."""

    def __init__(self, vocabulary: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = width
        self.length = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.length[i] = len(token)  # a character of a byte-level token is a byte
        self.cache = PieceCache(self._each, self._joined)

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _each(self, parts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Pieces encoded as one text; the tokens' lengths tell them apart."""
        packed: list[bytes] = []
        for i in range(0, len(parts), 5000):
            some = parts[i : i + 5000]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p.encode()) for p in some])) + 1
            own, at = self._pack(ids), 0
            for end in (ends * self.width).tolist():
                packed.append(own[at:end])
                at = end
        return packed

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [t for t in texts if SPECIAL not in t]
        done = iter(self.cache.ids(plain))
        return [
            next(done) if SPECIAL not in t else self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
            for t in texts
        ]


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def loaded(vocabulary: str, width: int) -> LibraryEncoder:
    """The encoder of a worker process; its cache outlives the tasks."""
    if (vocabulary, width) not in _encoders:
        _encoders[vocabulary, width] = LibraryEncoder(vocabulary, width)
    return _encoders[vocabulary, width]


def _writer(folder: str, vocabulary: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = None, TaskContext.get().partitionId()
        doc_ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        end = np.asarray([end_id], f"<u{width}").tobytes()
        out = None
        for batch in text_batches(batches):
            if out is None:
                encoder = loaded(vocabulary, width)
                # a name of its own for each attempt: the manifest names the file of the attempt that counts
                fs, base = pafs.FileSystem.from_uri(folder)
                path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.eft"
                out = fs.open_output_stream(path)
            packed = [p + end for p in encoder(batch["text"].fill_null("").to_pylist())]
            out.write(b"".join(packed))
            sizes.append(np.asarray([len(p) // width for p in packed], np.int64))
            doc_ids.append(batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        ends = np.cumsum(np.concatenate(sizes))
        code = EliasFano.build(ends, int(ends[-1]))
        parts = [np.concatenate(doc_ids), np.concatenate(nulls), code.low, code.high, code.samples]
        for part in parts:
            out.write(part.tobytes())
        footer = json.dumps(
            {"width": width, "n_docs": len(ends), "n_ids": int(ends[-1]), "low_bits": code.low_bits, "sizes": [p.nbytes for p in parts]}
        ).encode()
        out.write(footer + np.uint32(len(footer)).tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]}
        )

    return run


def write(
    docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2, end_id: int = 0
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files; returns the manifest.

    ``width`` is the bytes of an id and must hold the vocabulary. A null text is
    empty. Rows without id come first; rows with equal ids are ordered by text.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = bounded_batches(docs.sparkSession)
    folder = folder or scratch_path(spark, "token-files")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    ordered = pick(docs, doc_id=id_col, text=text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = saved(ordered.mapInArrow(_writer(folder, vocabulary, width, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), F.lit(folder).alias("folder"))


class Shard:
    """One file: its documents in order, or a single one by position."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        length = int(np.frombuffer(tail[:4], "<u4")[0])
        self.meta = json.loads(self._read(size - 12 - length, length))
        self.width, self.n_docs = self.meta["width"], self.meta["n_docs"]
        at, parts = self.meta["n_ids"] * self.width, []
        for n in self.meta["sizes"]:
            parts.append(self._read(at, n))
            at += n
        null = np.frombuffer(parts[1], np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(parts[0], "<i8"), null, strict=True)]
        low, high = (np.frombuffer(p, np.uint8) for p in parts[2:4])
        self.ends = EliasFano(self.n_docs, self.meta["low_bits"], low, high, np.frombuffer(parts[4], "<u8"))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, i: int) -> np.ndarray:
        """Ids of the document at position i, by two selects and one read."""
        start = self.ends.select(i - 1) if i else 0
        end = self.ends.select(i)
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def scan(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Runs of consecutive documents: position of the first, starts, and the ids of each."""
        ends = self.ends.values().astype(np.int64)
        starts = np.r_[0, ends[:-1]] if self.n_docs else ends
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + ids_at_once, "right")))
            raw = self._read(int(starts[i]) * self.width, int(ends[j - 1] - starts[i]) * self.width)
            ids = np.frombuffer(raw, f"<u{self.width}")
            yield i, starts[i:j], [ids[s - starts[i] : e - starts[i]] for s, e in zip(starts[i:j], ends[i:j], strict=True)]
            i = j


def read(manifest: DataFrame, column: Callable[[np.ndarray], object] | None = None, kind: str = "array<int>") -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens and ``ids``.

    ``column`` computes what the last column holds, of type ``kind``, from a
    document's id array; without it the column holds the ids. One task reads at
    least one file and streams it.
    """
    column = column or (lambda ids: ids.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                with fs.open_input_file(row["path"]) as file:
                    shard = Shard(file, fs.get_file_info(row["path"]).size)
                    for first, starts, docs in shard.scan():
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(shard.doc_ids[first : first + len(docs)], pa.int64()),
                                "start": pa.array(starts + row["base"], pa.int64()),
                                "n_tokens": pa.array([len(d) for d in docs], pa.int64()),
                                "ids": [column(d) for d in docs],
                            },
                            schema=out,
                        )

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", _arrow_type(kind))])
    spread = manifest.repartition(F.col("shard"))
    return spread.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids {kind}")


def _arrow_type(kind: str) -> pa.DataType:
    return {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "binary": pa.binary()}[kind]


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op2: encode, write, read back; start, length and checksum of each document."""
    import zlib

    import public_tokenizers

    from panelark.llm.common import documents

    manifest = write(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return read(manifest, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint").withColumnRenamed("ids", "ids_crc32")
