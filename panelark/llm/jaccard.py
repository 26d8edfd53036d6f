"""Exact Jaccard self-join of word shingle sets with adaptive multi-match prefixes, and its connected components.

All sets are ordered by one global order, rare shingles first. Two sets of n and
m shingles that are similar enough share at least ceil(3n/4) and ceil(3m/4)
shingles, so for any k their first n - ceil(3n/4) + k shingles share at least k.
Each document picks the k that is cheapest by the estimated lengths of its
shingles' lists: a longer prefix reads more lists, but a pair becomes a
candidate only by min(k) shared shingles.

Documents with equal sets are one class. Components need not see every pair: a
star round compares each class with one leader of the lists it is in; after
that only pairs of different components are still open, and all of these are
compared. A group of many near copies so costs a few comparisons a document,
and no link between two components is missed.

Bounds: the order comes from 2^FREQUENCY_BITS counters, filled with shingles
that are frequent within a task, and from a bitmap of shingles that several
prefixes held in an order without it: these go behind the others, so that texts
that only share a passage do not meet. Any order gives right results. Bitmaps
have a fixed size, and a false hit only adds a row that a join drops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelark.llm.bitmap import Bitmap, collect_bitmap, only
from panelark.llm.common import bounded_batches, documents, pick, saved
from panelark.llm.words import grams, text_batches, words

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4  # least similarity
FREQUENCY_BITS = 20
BITS = 26
MAX_MATCHES = 8
ORDERS = 2  # each but the first puts the shingles behind that the prefixes of the one before shared
STAR_ROUNDS = 1  # before all open pairs are listed


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words than ``size`` are one shingle."""
    found = words(texts, lower=True)
    first = found.first
    gram = grams(found.hash, size)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(gram[s : e - size + 1]))
        else:
            out.append(grams(found.hash[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int) -> int:
    return -(-NUMERATOR * n // DENOMINATOR)


def prefix(shingles: np.ndarray, frequency: np.ndarray, behind: Bitmap | None = None) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order, and the number of matches it asks for."""
    weight = frequency[(shingles >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
    if behind is not None:
        weight = weight + behind.has(shingles)
    order = np.lexsort((shingles, weight))
    n, least = len(shingles), least_overlap(len(shingles))
    k = np.arange(1, min(MAX_MATCHES, least) + 1)
    read = np.cumsum(weight[order], dtype=np.float64)[n - least + k - 1]
    cost = read + n * (read - (n - least + k)) / k  # entries read, and candidates to compare
    best = int(cost.argmin())
    return shingles[order[: n - least + int(k[best])]], int(k[best])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of each document; at the end the counters that stand out in this task."""
    counts, total = np.zeros(1 << FREQUENCY_BITS, np.int64), 0
    names = ["doc_id", "n", "c", "counter", "count"]
    for batch in text_batches(batches):
        sets = shingle_sets(batch["text"])
        both = np.concatenate(sets)
        np.add.at(counts, (both >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), 1)
        total += len(both)
        m = len(sets)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64()),
             pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names,
        )
        kind = batch.schema.field("doc_id").type
    if total:
        at = np.flatnonzero(counts >= max(8, 4 * total / len(counts)))
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(at, pa.int32()), pa.array(counts[at])], names
        )


def _prefixes(frequency: np.ndarray, shared: Bitmap | None, behind: Bitmap | None = None):
    """Hashes of all prefix shingles; or, of those in the bitmap, the list entries (a, c, n, place, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            hashes, rows = [np.zeros(0, np.uint64)], []
            for shingles in {class_key(s): s for s in shingle_sets(batch["text"]) if len(s)}.values():
                head, k = prefix(shingles, frequency, behind)
                place = np.arange(len(head))
                if shared is not None:
                    place = np.flatnonzero(shared.has(head))
                    rows.append((class_key(shingles), len(shingles), k, place))
                hashes.append(head[place])
            a = pa.array(np.concatenate(hashes).view(np.int64))
            if shared is None:
                yield pa.RecordBatch.from_arrays([a], ["a"])
            else:
                repeat = [len(r[3]) for r in rows]
                each = [pa.array(np.repeat(np.array([r[i] for r in rows], np.int64), repeat)) for i in range(3)]
                place = pa.array(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([a, each[0], each[1], place, each[2]], ["a", "c", "n", "place", "k"])

    return run


def _packed(carriers: Bitmap):
    """Sets (c, shingles) of the rows whose id's hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(only(batches, "_h", inside=carriers)):
            sets = {class_key(s): s for s in shingle_sets(batch["text"]) if len(s)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["c", "shingles"]
            )

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch["one"], batch["other"], strict=True):
            one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other))
            shared = len(one) + len(other) - len(np.unique(np.concatenate([one, other])))
            keep.append(DENOMINATOR * shared >= NUMERATOR * (len(one) + len(other) - shared))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, rows: DataFrame, lowest: DataFrame, bits: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar. ``rows`` has the texts, ``lowest`` an id of each class."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    carriers = collect_bitmap(asked.join(lowest, "c").select(F.xxhash64("low").alias("a")), bits)
    carrying = rows.select("text", F.xxhash64("doc_id").alias("_h"))
    sets = saved(carrying.mapInArrow(_packed(carriers), "c bigint, shingles binary").join(asked, "c", "left_semi"), "sets")
    one = sets.select(F.col("c").alias("u"), F.col("shingles").alias("one"))
    other = sets.select(F.col("c").alias("v"), F.col("shingles").alias("other"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInArrow(_similar, "u bigint, v bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(c, comp): the smallest node reachable from each node of the links (u, v).

    Each step takes the smallest label of the neighbours and then the label of
    the label, so the number of steps grows with the logarithm of the diameter.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = saved(both.where("u <> v").distinct(), "edges")
    labels = saved(edges.groupBy(F.col("u").alias("c")).agg(F.least(F.col("c"), F.min("v")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("c", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["c"] == near["u"]).select("c", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        root = lower.select(F.col("c").alias("comp"), F.col("comp").alias("root"))
        step = saved(lower.join(root, "comp", "left").select("c", F.least("comp", "root").alias("comp"), "was"), "labels")
        labels = step.select("c", "comp")
        if step.where("comp <> was").isEmpty():
            return labels


def _open_lists(entries: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Entries of the lists in which classes of several components are; each with its component and the list's largest one."""
    if comp is None:
        entries = entries.withColumn("comp", F.col("c"))
    else:
        entries = entries.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    one, own = Window.partitionBy("a"), Window.partitionBy("a", "comp")  # of one exchange
    lists = entries.repartition("a").withColumn("m", F.count(F.lit(1)).over(own))
    lists = lists.withColumns({"largest": F.max_by("comp", "m").over(one), "low": F.min("comp").over(one), "high": F.max("comp").over(one)})
    return saved(lists.where("low < high").drop("m", "low", "high"), "lists")


def _fits(n: str, m: str) -> str:
    return f"{DENOMINATOR} * least({n}, {m}) >= {NUMERATOR} * greatest({n}, {m})"


def _enough(m: str, n: str, k: str, other_n: str, other_k: str) -> str:
    """Whether m shared prefix shingles leave room for a link.

    Of the two prefixes one ends first in the global order. Shared shingles up to
    there are in both prefixes, and all others come after that prefix, which has
    n - ceil(3n/4) + k of the n shingles.
    """
    rest = [f"ceil({NUMERATOR}D * {a} / {DENOMINATOR}) - {b}" for a, b in ((n, k), (other_n, other_k))]
    return f"{NUMERATOR + DENOMINATOR} * ({m} + greatest({rest[0]}, {rest[1]})) >= {NUMERATOR} * ({n} + {other_n})"


def _star(lists: DataFrame, turn: int) -> DataFrame:
    """One pair for each class: with that leader of its lists that it shares most entries with.

    A list is led by the class that is in most open lists, which of near copies
    is the least changed one; after the first turn, by one outside the list's largest component.
    """
    degree = lists.groupBy("c").agg(F.count(F.lit(1)).alias("degree"))
    able = lists if not turn else lists.where("comp <> largest")
    rank = F.col("degree") * (1 << 20) + F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(1 << 20))
    lead = able.select("a", "c").join(degree, "c").groupBy("a").agg(F.max_by("c", rank).alias("u"))
    shared = lists.join(lead, "a").where("c <> u").groupBy("u", "c").agg(
        F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.min("k").alias("k"), F.min("comp").alias("comp")
    )
    leader = lists.groupBy(F.col("c").alias("u")).agg(F.min("n").alias("un"), F.min("k").alias("uk"), F.min("comp").alias("ucomp"))
    good = shared.join(leader, "u").where(f"comp <> ucomp AND m >= least(k, uk) AND {_fits('n', 'un')} AND {_enough('m', 'n', 'k', 'un', 'uk')}")
    return good.groupBy(F.col("c").alias("v")).agg(F.max_by("u", "m").alias("u")).select("u", "v")


def _all_open(lists: DataFrame) -> DataFrame:
    """All candidate pairs of classes of different components.

    First the pairs that share one of the first n - overlap + 1 shingles of both
    sets, for the overlap that their two sizes ask for; they are few, as these
    are the rarest ones. In a list at least one of such a pair is outside the
    list's largest component; that one is the left side. Then the shingles that
    a pair shares in its lengthened prefixes are counted.
    """
    both = NUMERATOR + DENOMINATOR
    early = lists.where(f"place <= n - ceil({NUMERATOR}D * n / {DENOMINATOR})")
    left = early.where("comp <> largest").select("a", *[F.col(c).alias(f"l_{c}") for c in ("c", "n", "place", "comp")])
    meet = f"""l_comp <> comp AND (comp = largest OR l_c < c) AND {_fits('l_n', 'n')}
      AND {both} * (l_n - l_place) >= {NUMERATOR} * (l_n + n) AND {both} * (n - place) >= {NUMERATOR} * (l_n + n)"""
    pairs = left.join(early, "a").where(meet).select(F.col("l_c").alias("u"), F.col("c").alias("v")).distinct()
    one = lists.select(F.col("c").alias("u"), "a", F.col("n").alias("u_n"), F.col("k").alias("u_k"))
    other = lists.select(F.col("c").alias("v"), "a", "n", "k")
    shared = pairs.join(one, "u").join(other, ["v", "a"]).groupBy("u", "v")
    counted = shared.agg(F.count(F.lit(1)).alias("m"), *[F.min(c).alias(c) for c in ("u_n", "u_k", "n", "k")])
    return counted.where(f"m >= least(u_k, k) AND {_enough('m', 'u_n', 'u_k', 'n', 'k')}").select("u", "v")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null texts and texts without words have no shingles and are linked with
    nothing. Rows with equal texts are linked, also under one id. A row without
    an id has its n_shingles and no component, and links nothing.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    survey = saved(rows.mapInArrow(_survey, f"doc_id {kind}, n bigint, c bigint, counter int, count bigint"), "survey")
    members = survey.where("counter is null").select("doc_id", "n", "c")
    frequency = np.ones(1 << FREQUENCY_BITS, np.int64)
    for r in survey.where("counter is not null").groupBy("counter").agg(F.sum("count").alias("n")).collect():  # at most 2^FREQUENCY_BITS
        frequency[r["counter"]] = r["n"]
    named = rows.where("doc_id is not null")
    lowest = members.where("doc_id is not null and n > 0").groupBy("c").agg(F.min("doc_id").alias("low"))

    behind = shared = None
    for _ in range(ORDERS):
        if shared is not None:
            behind = shared if behind is None else Bitmap(bits, behind.data | shared.data)
        heads = named.select("text").mapInArrow(_prefixes(frequency, None, behind), "a bigint")
        shared = collect_bitmap(heads.groupBy("a").count().where("count > 1").select("a"), bits)
    entry = "a bigint, c bigint, n bigint, place bigint, k bigint"
    found = named.select("text").mapInArrow(_prefixes(frequency, shared, behind), entry)
    entries = saved(found.groupBy("a", "c").agg(*[F.min(x).alias(x) for x in ("n", "place", "k")]), "entries")  # copies are one entry

    links = comp = None
    for turn in range(STAR_ROUNDS + 1):
        lists = _open_lists(entries, comp)
        if lists.isEmpty():
            break
        last = turn == STAR_ROUNDS
        pairs = saved(_all_open(lists) if last else _star(lists, turn), "pairs")
        if not pairs.isEmpty():
            new = saved(verified(pairs, named, lowest, bits), "links")
            links = new if links is None else links.union(new)
            if not new.isEmpty():
                comp = components(links)
        if last:
            break
    if comp is None:
        comp = spark.createDataFrame([], "c bigint, comp bigint")
    root = lowest.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = root.groupBy("comp").agg(F.min("low").alias("component"))
    result = root.join(least, "comp").select("c", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")))
    return members.join(result, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op8: shingle set size and component of every document."""
    return join(documents(spark, folder))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline: of each component the document with the smallest id stays, once.

    Documents without words are linked with nothing and stay; so do rows without an id.
    """
    groups = saved(join(docs).where("doc_id is not null").select("doc_id", "component_id").distinct(), "groups")
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    return left.select(*docs.columns)
