"""Vector code compression: product quantisation in exact integer arithmetic.

Components become integers, vectors are cut into equal parts, and each part is
replaced by the number of the nearest entry of its codebook. Distances come from
matrix products in float64 that are exact: integers are split into limbs of so
few bits that no sum of products reaches 2^53, and the limbs' products are put
together again in 64-bit integers. So results depend on neither the BLAS in use
nor the order of rows, and a tie is a tie.

A codebook is PARTS x ENTRIES rows at most whatever the table, so codebooks go
to the tasks and one row per entry and task comes back to be summed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.llm.common import bounded_batches, pick, saved

# Fixed values of the contract.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

BLOCK = 4096  # vectors whose distances to a codebook are held at once
SMALL_LABELS = 100_000  # label sums up to this number are broadcast, more are joined by a shuffle

Codebooks = np.ndarray  # int64 of shape (parts, entries, width)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs of ``bits`` bits, lowest first; each is in [-2^(bits-1), 2^(bits-1)], zero limbs at the top left out."""
    out, half = [], np.int64(1 << (bits - 1))
    while not out or values.any():
        low = ((values + half) & np.int64((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        values = (values - low) >> np.int64(bits)
    return out


def limb_bits(width: int) -> int:
    """Most bits of a limb with ``width`` products of two limbs summing below 2^53."""
    return (53 - max(width - 1, 1).bit_length()) // 2


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the int64 rows of ``a`` with those of ``b``, as long as they fit in 64 bits."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    ours, theirs = limbs(a, bits), limbs(b, bits)
    for i, x in enumerate(ours):
        for j, y in enumerate(theirs):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def largest(width: int) -> int:
    """The largest size of an integer component of which squared distances over ``width`` components fit in 64 bits."""
    return math.isqrt(((1 << 63) - 1) // max(width, 1)) // 2


def assign(values: np.ndarray, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower index, and its squared distance; both of shape (rows, parts)."""
    parts, _, width = codebooks.shape
    codes = np.empty((len(values), parts), np.int64)
    errors = np.empty((len(values), parts), np.int64)
    for part, book in enumerate(codebooks):
        norms = (book * book).sum(axis=1)
        for i in range(0, len(values), BLOCK):
            x = values[i : i + BLOCK, part * width : (part + 1) * width]
            far = norms - 2 * dot(x, book) + (x * x).sum(axis=1)[:, None]
            best = far.argmin(axis=1)
            codes[i : i + BLOCK, part], errors[i : i + BLOCK, part] = best, far[np.arange(len(x)), best]
    return codes, errors


def integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array that are kept, and their integer components.

    A row is kept if it has ``length`` components, all of them finite numbers.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    right = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(right)).flatten()
    table = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(right), length)
    good = np.isfinite(table).all(axis=1)
    scaled = np.floor(table[good] * SCALE)
    bound = largest(length // PARTS)
    if scaled.size and np.abs(scaled).max() > bound:
        raise ValueError(f"a component is beyond {bound / SCALE:.0f}; squared distances would not fit in 64 bits")
    return right[good], scaled.astype(np.int64)


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can be coded: a positive multiple of PARTS finite components."""
    size = F.size("vector")
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vector").isNotNull() & (size > 0) & (size % PARTS == 0)).where(~wrong)


def first_codebooks(vectors: DataFrame) -> Codebooks | None:
    """Parts of the ENTRIES kept rows with the smallest ids, or None if no row is kept.

    Null ids come last, rows of one id are ordered by vector. The length of the
    first vector is the length of the codebook; rows of another length are left out.
    """
    head = kept(vectors).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    order = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    rows = head.orderBy(*order).limit(ENTRIES).collect()
    if not rows:
        return None
    length = len(rows[0].vector)
    if any(len(r.vector) != length for r in rows):
        rows = head.where(F.size("vector") == length).orderBy(*order).limit(ENTRIES).collect()
    _, values = integers(pa.array([r.vector for r in rows], pa.list_(pa.float64())), length)
    return values.reshape(len(rows), PARTS, length // PARTS).transpose(1, 0, 2).copy()


def _sums(codebooks: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, entries, width = codebooks.shape
    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)

        def out() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            columns = [part, entry, counts[part, entry], *sums[part, entry].T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

        held, room = 0, ((1 << 63) - 1) // largest(width)
        for batch in batches:
            _, values = integers(batch["vector"], parts * width)
            if held + len(values) > room:  # before a sum could leave 64 bits
                yield out()
                counts[:], sums[:], held = 0, 0, 0
            held += len(values)
            codes, _ = assign(values, codebooks)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], values[:, p * width : (p + 1) * width])
        yield out()

    return run


def refine(vectors: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every used entry to the floor of the mean of its parts."""
    _, _, width = codebooks.shape
    schema = ", ".join(["part long", "entry long", "n long", *[f"s{j} long" for j in range(width)]])
    partial = vectors.select("vector").mapInArrow(_sums(codebooks), schema)
    # sums over all tasks may pass 64 bits even if each task's do not
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *[f"s{j}" for j in range(width)]]]
    out = codebooks.copy()
    for row in partial.groupBy("part", "entry").agg(*total).collect():
        out[row.part, row.entry] = [int(row[f"s{j}"]) // int(row.n) for j in range(width)]
    return out


def train(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table (vec_id, vector), or None if it has no row to code."""
    codebooks = first_codebooks(vectors)
    for _ in range(rounds if codebooks is not None else 0):
        codebooks = refine(vectors, codebooks)
    return codebooks


def _coded(codebooks: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = codebooks.shape
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch["vector"], parts * width)
            codes, errors = assign(values, codebooks)
            text = digits[codes].sum(axis=1) if len(codes) else []
            same = batch.drop_columns(["vector"]).take(pa.array(rows))
            added = [pa.array(text, pa.string()), pa.array(errors.sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*same.columns, *added], [*same.schema.names, "code", "error"])

    return run


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """The rows that can be coded, with ``code`` and ``error`` in place of the vector."""
    rest = [f for f in vectors.schema.fields if f.name != "vector"]
    schema = T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.mapInArrow(_coded(codebooks), schema)


def decode(codes: DataFrame, codebooks: Codebooks, code_col: str = "code") -> DataFrame:
    """The rows with ``vector`` added: the entries that a code names, as numbers of the original scale."""
    parts, entries, width = codebooks.shape
    flat = F.lit([float(x) for x in (codebooks / SCALE).reshape(-1)])

    def entry(part: int) -> F.Column:
        at = F.conv(F.substring(code_col, 2 * part + 1, 2), 16, 10).cast("int") + part * entries
        return F.slice(flat, at * width + 1, width)

    return codes.withColumn("vector", F.concat(*[entry(p) for p in range(parts)]))


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per coded vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows with a null vector, a null or non-finite component, or a length other
    than that of the first kept vector (which must be a multiple of four) are left out.
    Repeated rows are coded each by itself and count each in the codebooks.
    Null labels form one group. An empty table gives an empty result. Components
    that would take a squared distance beyond 64 bits are an error.
    """
    spark = bounded_batches(embeddings.sparkSession)
    rows = pick(embeddings, vec_id=id_col, vector=vector_col, label=label_col)
    codebooks = train(rows)
    if codebooks is None:
        kinds = dict(rows.dtypes)
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = saved(encode(rows, codebooks), "vector-codes")
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "label-errors")
    side = F.broadcast(sums) if sums.count() <= SMALL_LABELS else sums
    joined = coded.join(side, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op11: codes of all embeddings."""
    return compress(bounded_batches(spark).read.parquet(f"{folder}/embeddings.parquet"))


def _sql() -> str:
    """The same in DuckDB: one common table for each round of each codebook."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
              row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS (SELECT max(len(v)) // 4 AS width FROM kept)",
        """cells AS MATERIALIZED (SELECT r, (i - 1) // width AS part, (i - 1) % width AS j, v[i] AS x
            FROM kept, w, unnest(range(1, 4 * width + 1)) AS t(i))""",
        f"book0 AS MATERIALIZED (SELECT part, r AS entry, j, x AS c FROM cells WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, part, min(entry) AS entry, any_value(d) AS d FROM (
            SELECT r, part, entry, d, min(d) OVER (PARTITION BY r, part) AS least FROM (
              SELECT r, a.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
              FROM cells a JOIN book{k} b ON a.part = b.part AND a.j = b.j GROUP BY ALL)) WHERE d = least GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT n.part, n.entry, a.j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM near{k} n JOIN cells a ON a.r = n.r AND a.part = n.part GROUP BY ALL)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, entry, j, CASE WHEN n IS NULL THEN c
                ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN mean{k} USING (part, entry, j))""")
    last = ROUNDS
    return f"""WITH {', '.join(steps)},
      coded AS (SELECT r, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY r)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) FROM book{last}) AS codebooks_sha256
      FROM coded JOIN kept USING (r)"""


ORACLE = _sql()
