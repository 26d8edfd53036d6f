"""Log-probabilities of texts under a log-bilinear model trained by noise-contrastive estimation.

Vocabulary: all words seen at least MIN_COUNT times in training (at most 2^FREQUENT_BITS,
the most frequent ones), the end of a text, and FORMS classes for all other words,
by their last bytes. The model predicts a word's vector from the two before it,
each scaled by weights of its place; its score is the product with the vector of
the word plus the word's bias. Scores are normalised in two levels, over about the
root of the vocabulary each: first the group of the word, which has a vector
and a bias of its own, then the words of that group. A word outside the vocabulary
gets the probability of its form times its smoothed share in the form.

In each round tasks train on all training texts they read, from the same start;
then each vector is averaged, weighted by how often each task has seen its word,
and sent to all tasks for the next round.

Counts of all words are a distributed table. Words of the vocabulary are
counted where a text is read; the others of each text meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, documents, pick, saved
from panelark.llm.language_id import fold
from panelark.llm.words import Words, mix, text_batches, words

WIDTH = 16
ROUNDS = 2
NOISE = 128  # noise words of a step, shared by its examples
STEP = 2048  # most examples of a step
RATE = 0.05
SQUARE = 1e-2  # squared gradient that rates start from
ADD = 0.1  # of the contract
MIN_COUNT = 3  # of a word of the vocabulary
FREQUENT_BITS = 17
FORM_BITS, FORM_BYTES = 10, 3  # classes of the other words, and the last bytes that choose one
FORMS = 1 << FORM_BITS
END = int(mix(np.array([0x454E44], np.uint64))[0])  # stands for the end among word hashes
CONTEXTS = 4096  # tokens normalised at once
HELD_WORDS = 1 << 20  # different words that a task holds before it merges equal ones

STOP = FORMS  # class of the end; forms come before, words of the vocabulary follow


class Vocabulary(NamedTuple):
    """Sorted hashes of the vocabulary's words and END, their counts and their classes; totals of the other words by form."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    share: np.ndarray  # of each class among training tokens
    z: np.ndarray  # smoothed count of all words of each form

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it is outside the vocabulary."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def forms(found: Words) -> np.ndarray:
    """Class of each word by its last bytes."""
    out = np.zeros(len(found.start), np.uint64)
    for i in range(1, FORM_BYTES + 1):
        inside = found.end - i >= found.start
        out = out * np.uint64(257) + np.where(inside, found.data[np.maximum(found.end - i, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(out) >> np.uint64(64 - FORM_BITS)).astype(np.int64)


def sequences(found: Words, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each token (words, then the end), and the classes of the tokens and of the two before them."""
    n = len(found.offsets) - 1
    first = found.first
    text = np.concatenate([found.doc, np.arange(n)])
    kind = np.concatenate([np.where(at >= 0, vocabulary.classes[at] if len(vocabulary.classes) else 0, forms(found)), np.full(n, STOP)])
    place = np.concatenate([np.arange(len(found.doc)) - first[found.doc], np.diff(first)])
    order = np.argsort(text, kind="stable")
    text, kind, place = text[order], kind[order], place[order]
    before = np.full((len(kind), 2), STOP)
    before[1:, 0] = np.where(place[1:] >= 1, kind[:-1], STOP)
    before[2:, 1] = np.where(place[2:] >= 2, kind[:-2], STOP)
    return text, kind, before


def groups(k: int) -> int:
    """Number of groups of k classes; class i is in group i % groups(k)."""
    return max(1, round(k**0.5))


class Model(NamedTuple):
    context: np.ndarray  # classes x WIDTH
    places: np.ndarray  # 2 x WIDTH, weights of the last word and the one before
    target: np.ndarray  # classes, then groups, x WIDTH
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        k, g = len(share), groups(len(share))
        draw = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        of_group = np.bincount(np.arange(k) % g, share, g)
        bias = np.log(np.r_[share, of_group]).astype(np.float32)
        return cls(draw(k), np.array([[1.0], [0.5]], np.float32) * np.ones((2, WIDTH), np.float32), draw(k + g) * 0.1, bias)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return self.context[before[:, 0]] * self.places[0] + self.context[before[:, 1]] * self.places[1]

    def log10_of(self, before: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class after its context."""
        k = len(self.context)
        g = groups(k)
        h, out = self.predicted(before), np.empty(len(kind), np.float64)
        own = kind % g
        for i in range(0, len(kind), CONTEXTS):
            part = slice(i, i + CONTEXTS)
            out[part] = _log_softmax(h[part] @ self.target[k:].T + self.bias[k:], own[part])
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(g + 1))
        for j in np.flatnonzero(np.diff(ends)):
            target, bias = np.ascontiguousarray(self.target[j:k:g].T), self.bias[j:k:g]
            for i in range(ends[j], ends[j + 1], CONTEXTS):
                part = order[i : min(i + CONTEXTS, ends[j + 1])]
                out[part] += _log_softmax(h[part] @ target + bias, kind[part] // g)
        return out / np.log(10)

    def log10_probabilities(self, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes after each context."""
        k = len(self.context)
        return self.log10_of(np.repeat(before, k, axis=0), np.tile(np.arange(k), len(before))).reshape(-1, k)


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    if logits.max() > 60 or logits.min() < -60:  # of 32-bit numbers
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _totals(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    return sorted_rows[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Weighted noise-contrastive steps with AdaGrad rates, for the classes and for their groups."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.model = Model(*(p.copy() for p in model))
        self.squares = Model(*(np.full_like(p, SQUARE) for p in model))
        k, g = len(share), groups(len(share))
        share = share / share.sum()
        of_group = np.bincount(np.arange(k) % g, share, g)
        self.groups = g
        # first row, shares, their running sums and logarithms
        self.levels = [(start, x, np.cumsum(x), np.log(NOISE * x).astype(np.float32)) for start, x in ((0, share), (k, of_group))]
        self.seen = {"target": np.zeros(k + g), "context": np.zeros(k)}  # weight of the examples of each row
        self.rng = np.random.default_rng(seed)

    def _descend(self, parts: tuple[str, ...], rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> None:
        """One step of the rows; the columns of ``gradient`` belong to the parts one after the other."""
        hit, total = _totals(rows, np.concatenate([gradient, weight[:, None]], axis=1))
        self.seen[parts[0]][hit] += total[:, -1]
        i = 0
        for part in parts:
            p, s = getattr(self.model, part), getattr(self.squares, part)
            g = total[:, i : i + WIDTH] if p.ndim == 2 else total[:, i]
            i += WIDTH
            square = s[hit] + g * g
            s[hit] = square
            p[hit] -= RATE * g / np.sqrt(square)

    def step(self, before: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> None:
        m = self.model
        weight = weight.astype(np.float32)
        last = m.context[before[:, 0]], m.context[before[:, 1]]
        h = last[0] * m.places[0] + last[1] * m.places[1]
        g_h = np.zeros_like(h)
        ones = np.ones(NOISE, np.float32)
        for (start, share, edges, log_noise), own_class in zip(self.levels, (kind, kind % self.groups), strict=True):
            drawn = np.minimum(np.searchsorted(edges, self.rng.random(NOISE), "right"), len(share) - 1)
            row, noise = start + own_class, start + drawn
            target, against = m.target[row], m.target[noise]
            # NOISE shared words stand for NOISE noise samples of each example
            own = np.einsum("ij,ij->i", h, target) + m.bias[row] - log_noise[own_class]
            others = h @ against.T
            others += m.bias[noise] - log_noise[drawn]
            np.clip(others, -30, 30, out=others)
            np.exp(np.negative(others, out=others), out=others)
            others += 1
            g_own = -weight / (1 + np.exp(np.clip(own, -30, 30)))
            g_others = np.divide(weight[:, None], others, out=others)
            g_h += g_own[:, None] * target + g_others @ against
            g_target = np.concatenate([np.c_[g_own[:, None] * h, g_own], np.c_[g_others.T @ h, g_others.sum(0)]])
            self._descend(("target", "bias"), np.concatenate([row, noise]), g_target, np.concatenate([weight, ones]))
        g_places = np.stack([np.einsum("ij,ij->j", g_h, x) for x in last])
        g_context = np.concatenate([g_h * m.places[0], g_h * m.places[1]])
        self.squares.places[:] += g_places**2
        m.places[:] -= RATE * g_places / np.sqrt(self.squares.places)
        self._descend(("context",), np.concatenate([before[:, 0], before[:, 1]]), g_context, np.concatenate([weight, weight]))

    def learn(self, before: np.ndarray, kind: np.ndarray) -> None:
        """Steps over the different (context, word) examples, weighted by how often they occur."""
        k = len(self.model.context)
        examples, count = np.unique((before[:, 1] * k + before[:, 0]) * k + kind, return_counts=True)
        order = self.rng.permutation(len(examples))
        size = min(STEP, max(64, len(order) // 128))  # few examples still make many steps
        for i in range(0, len(order), size):
            e, n = examples[order[i : i + size]], count[order[i : i + size]]
            self.step(np.stack([e // k % k, e // k**2], axis=1), e % k, n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, kinds, counts, size = [], [], [], 0

    def merged() -> pa.RecordBatch:
        keys, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate(kinds)[first]), pa.array(n)], ["w", "form", "c"])

    for batch in text_batches(batches):
        texts = words(batch["text"], lower=True)
        every = np.r_[texts.hash, np.full(batch.num_rows, END, np.uint64)]
        found, first, n = np.unique(every, return_index=True, return_counts=True)
        hashes.append(found)
        kinds.append(np.r_[forms(texts), np.full(batch.num_rows, STOP)][first].astype(np.int32))
        counts.append(n)
        size += len(found)
        if size > HELD_WORDS:
            yield merged()
            hashes, kinds, counts, size = [], [], [], 0
    if hashes:
        yield merged()


def count_words(docs: DataFrame) -> DataFrame:
    """(w, form, c): training counts of all words, by 64-bit hash, and of END."""
    return docs.mapInArrow(_count, "w bigint, form int, c bigint").groupBy("w").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The words counted most often, with END, and the count that they reach at least; all totals are by form."""
    room, low = 1 << FREQUENT_BITS, MIN_COUNT
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect():  # counts that differ: at most the root of twice the tokens
        room -= r["n"]
        if room < 0:
            low = max(low, r["c"] + 1)
            break
    signed = int(np.uint64(END).astype(np.int64))
    inside = (F.col("c") >= low) | (F.col("w") == signed)
    table = counts.where(inside).select("w", "c").toArrow()
    hashes, n = table["w"].to_numpy().astype(np.int64).view(np.uint64), table["c"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    end = hashes == np.uint64(END)
    classes = np.full(len(hashes), STOP)
    ranked = np.lexsort((hashes, -n))
    ranked = ranked[~end[ranked]]
    classes[ranked] = np.arange(len(ranked)) + STOP + 1
    share = np.bincount(classes, n, STOP + 1 + len(ranked)).astype(float)
    share[STOP] = max(1, share[STOP])
    z = np.full(FORMS, ADD)
    for r in counts.where(~inside).groupBy("form").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).collect():
        share[r["form"]] += r["c"]
        z[r["form"]] += r["c"] + ADD * r["types"]
    share[:FORMS] += 1.0
    return Vocabulary(hashes, n, classes, share / share.sum(), z), low


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Averages of the vectors that all tasks reach, each weighted by its examples; every round starts from the last one's."""
    model = Model.start(known.share)
    k, cells = len(model.context), [f"p{j}" for j in range(WIDTH + 1)]
    context = docs.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast((model, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            model, known = shared.value
            trainer, seen = Trainer(model, known.share, 1000003 * turn + TaskContext.get().partitionId()), 0
            for batch in text_batches(batches):
                found = words(batch["text"], lower=True)
                _, kind, before = sequences(found, known.find(found.hash), known)
                trainer.learn(before, kind)
                seen += len(kind)
            if seen:
                m = trainer.model
                values = np.vstack([np.c_[m.target, m.bias], np.pad(np.vstack([m.context, m.places]), ((0, 0), (0, 1)))])
                n = np.r_[trainer.seen["target"], trainer.seen["context"], [float(seen)] * 2]
                for at in np.array_split(np.flatnonzero(n), max(1, len(n) // 10000)):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(values[at, j]) for j in range(WIDTH + 1))], ["i", "n", *cells])

        schema = "i bigint, n double, " + ", ".join(f"{c} float" for c in cells)
        means = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in cells]
        table = docs.mapInArrow(run, schema).groupBy("i").agg(*means).toArrow()
        values = np.vstack([np.c_[model.target, model.bias], np.pad(np.vstack([model.context, model.places]), ((0, 0), (0, 1)))])
        at = table["i"].to_numpy().astype(np.int64)
        for j, c in enumerate(cells):
            values[at, j] = table[c].to_numpy()
        t = len(model.target)
        model = Model(values[t : t + k, :WIDTH].copy(), values[t + k :, :WIDTH].copy(), values[:t, :WIDTH].copy(), values[:t, WIDTH].copy())
        shared.unpersist()
    return model


def _scored(shared, z: float):
    """Row number, id, tokens, and what is known without the other words; the other words and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in text_batches(batches):
            found = words(batch["text"], lower=True)
            n = batch.num_rows
            at = known.find(found.hash)
            text, kind, before = sequences(found, at, known)
            score = model.log10_of(before, kind)
            frequent = at >= 0
            log_c = np.log10((known.counts + ADD) / z)
            end = known.find(np.array([END], np.uint64))[0]
            log_end = np.log10(((known.counts[end] if end >= 0 else 0) + ADD) / z)
            own = np.where(frequent, log_c[at] if len(log_c) else 0.0, 0.0)
            rare = ~frequent
            in_form = np.log10(z / known.z)[forms(found)]
            order = np.lexsort((found.hash[rare], found.doc[rare]))
            doc, hashes = found.doc[rare][order], found.hash[rare][order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])][: len(doc)])
            times = np.diff(np.r_[new, len(doc)])
            cut = np.searchsorted(doc[new], np.arange(n + 1))
            offsets = pa.array(cut.astype(np.int32))
            sums = lambda x, where: np.bincount(found.doc[where], x[where], n).astype(float)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)),
                    batch["doc_id"],
                    pa.array(np.diff(found.first) + 1),
                    pa.array(np.bincount(found.doc[frequent], minlength=n) + int(end >= 0)),
                    pa.array(sums(own, frequent) + log_end),
                    pa.array(np.bincount(text, score, n) + sums(in_form, rare)),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes[new].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                ],
                ["row", "doc_id", "n_tokens", "n_frequent", "log_c", "log_p", "rare", "times"],
            )
            row += n

    return run


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, the end. Without training texts no
    token is known and the model is uniform over the classes. Every repeated row
    is scored; words are told apart by 64-bit hashes. Scores are log10.
    """
    spark = bounded_batches(docs.sparkSession)
    texts = pick(training, text=text_col)
    counts = saved(count_words(texts), "word-counts")
    total = counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    tokens, types = total["tokens"] or 0, total["types"]
    known, low = vocabulary(counts)
    model = train(texts, known, rounds)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row bigint, doc_id {kind}, n_tokens bigint, n_frequent bigint, log_c double, log_p double, "
        "rare array<bigint>, times array<int>"
    )
    z = tokens + ADD * (types + 1)
    scored = saved(rows.mapInArrow(_scored(spark.sparkContext.broadcast((model, known)), z), schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("m"))
    # the words that were counted where they were read are not in the table's other part
    others = counts.where(F.col("c") < low)
    c = F.coalesce("c", F.lit(0))
    found = rare.join(others, "w", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10((c + ADD) / z)).alias("log_c_rare"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("n_known_rare")
    )
    extra = F.coalesce("log_c_rare", F.lit(0.0))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_known_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_c") + extra).alias("base_score"),
        (F.col("log_p") + extra).alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op10: scores of all documents, learned from those outside fold 0 of 10."""
    docs = documents(spark, folder)
    out = score(docs, docs.where(fold("doc_id", 10) != 0))
    held = (fold("doc_id", 10) == 0).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
