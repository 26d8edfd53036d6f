"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity by language.

The language model is modified Kneser-Ney over four characters as they stand:
the symbols are the UTF-16 units of the text, so no two characters are one, and
an n-gram is a 64-bit number. Spark counts the n-grams of all texts and works
out all orders as tables, whatever their number. The HELD entries counted most
often go to the tasks as sorted hashes; the n-grams of a text that are not among
them meet the table in a join. As whole n-grams can be learned by heart, each half
of the texts is scored by the model of the other half. A document is rejected when
its perplexity leaves its language's band, which comes from the quartiles of all
documents of the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, documents, pick, saved
from panelark.llm.words import grams, mix, text_batches, words

UNIT = 16  # bits of a symbol
SYMBOLS = 1 << UNIT
ORDER = 4
LANGUAGES = 32  # languages with a model of their own; all others share one
POOLED = "*"
HELD_ENTRIES = 1 << 20  # n-grams that a task holds before it merges equal ones
FOLDS = 2  # a text is scored by the model of the next fold; equal texts are in one fold
HELD = 1 << 20  # entries of all models that are sent to tasks
MARKS = "#*$%&|<>"

# Rules of the contract.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
# Width of a band: so many quartile distances from the median, and at least so much in log10 of the perplexity.
SPREADS, LEAST_WIDTH = 10.0, 0.2


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the n-gram that ends at each symbol and after the last one, and the text it is in.

    A text is preceded by spaces and followed by one.
    """
    pad = " " * (ORDER - 1)
    parts = [f"{pad}{t} ".encode("utf-16-le", "surrogatepass") for t in texts]
    symbol = np.frombuffer(b"".join(parts), np.uint16).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(part) // 2 for part in parts])
    code = np.zeros(max(0, len(symbol) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(UNIT)) | symbol[k : k + len(code)]
    inside = text[: len(code)] == text[ORDER - 1 :]
    return code[inside], text[: len(code)][inside]


def _suffix(order: int, code: np.ndarray) -> np.ndarray:
    """The last ``order`` - 1 symbols."""
    return code & np.uint64((1 << UNIT * (order - 1)) - 1)


class Model(NamedTuple):
    """Sorted hashes of n-grams of all orders, their log10 probabilities and back-off weights."""

    keys: np.ndarray
    log_p: np.ndarray
    back_off: np.ndarray

    def find(self, order: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability (nan if not stored) and log back-off weight (0 if not stored)."""
        key = _key(order, code)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.log_p[at], np.nan), np.where(hit, self.back_off[at], 0.0)

    def log_probability(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log10 probability of the last symbol of each n-gram after the others, from the entries of this model."""
        if order == 0:
            return np.full(len(code), -np.log10(SYMBOLS))
        code = code.astype(np.uint64)
        out, _ = self.find(order, code)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            _, weight = self.find(order - 1, code[rest] >> np.uint64(UNIT))
            out[rest] = weight + self.log_probability(_suffix(order, code[rest]), order - 1)
        return out

    @classmethod
    def of(cls, order: np.ndarray, code: np.ndarray, p: np.ndarray, weight: np.ndarray) -> Model:
        """From probabilities and weights, nan where an entry has none; no entry comes twice."""
        key = _key(order, code)
        at = np.argsort(key, kind="stable")
        back_off = np.nan_to_num(np.log10(np.maximum(weight[at], 1e-12)))
        return cls(key[at], np.log10(p[at]).astype(np.float32), back_off.astype(np.float32))


def _key(order: int | np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + mix(np.full(len(code), order).astype(np.uint64) + np.uint64(1)))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen one to four times."""
    return _discounts_from([int((counts == k).sum()) for k in range(1, 5)])


def _discounts_from(n: list[int]) -> np.ndarray:
    if min(n) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0, *np.clip(found, [0.05, 0.05, 0.05], [0.95, 1.9, 2.9])])


def kneser_ney(code: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated modified Kneser-Ney model from counts of the longest n-grams that fit in memory; ``train`` does the same on tables."""
    found, inverse = np.unique(code.astype(np.uint64), return_inverse=True)
    levels = [(found, np.bincount(inverse, count, len(found)).astype(np.int64))]
    for order in range(ORDER, 1, -1):  # lower orders count the different symbols before them
        levels.append(np.unique(_suffix(order, levels[-1][0]), return_counts=True))
    below, lower = np.zeros(1, np.uint64), np.full(1, 1.0 / SYMBOLS)
    ngrams, contexts = [], []
    for order in range(1, ORDER + 1):
        found, counts = levels[ORDER - order]
        d = _discounts(counts)
        context, at = np.unique(found >> np.uint64(UNIT), return_inverse=True)
        total = np.bincount(at, counts, len(context))
        n1, n2, n3 = (np.bincount(at, np.minimum(counts, 3) == k, len(context)) for k in (1, 2, 3))
        weight = (d[1] * n1 + d[2] * n2 + d[3] * n3) / total
        p = np.maximum(counts - d[np.minimum(counts, 3)], 0) / total[at] + weight[at] * lower[np.searchsorted(below, _suffix(order, found))]
        ngrams.append((order, found, p))
        contexts.append((order - 1, context, weight))
        below, lower = found, p
    rows: dict[tuple[int, int], list[float]] = {}
    for order, found, p in ngrams:
        rows.update({(order, int(c)): [x, np.nan] for c, x in zip(found, p, strict=True)})
    for order, found, weight in contexts:  # an n-gram and a context of the same symbols are one entry
        for c, x in zip(found, weight, strict=True):
            rows.setdefault((order, int(c)), [np.nan, np.nan])[1] = x
    values = np.array(list(rows.values())).reshape(-1, 2)
    return Model.of(np.array([k[0] for k in rows]), np.array([k[1] for k in rows], np.uint64), values[:, 0], values[:, 1])


def _fold(text: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(folds)).cast("int")


def _parts(batch: pa.RecordBatch, place: dict[str, int], folds: int, turn: int) -> Iterator[tuple[int, np.ndarray]]:
    """The models, ``turn`` folds on, of a batch's rows with a text, each with the rows it is for."""
    of = np.array([place.get(x, len(place)) for x in batch["lang"].to_pylist()], np.int64)
    of = of * folds + (batch["fold"].to_numpy() + turn) % folds
    of[batch["text"].is_null().to_numpy(zero_copy_only=False)] = -1
    for model in np.unique(of[of >= 0]).tolist():
        yield model, np.flatnonzero(of == model)


def _counter(languages: list[str], folds: int):
    place = {lang: i for i, lang in enumerate(languages)}

    def merged(pending: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        out = {}
        for model, seen in pending.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            out[model] = [(keys, np.bincount(inverse, np.concatenate([n for _, n in seen]), len(keys)).astype(np.int64))]
        return out

    def size(pending: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> int:
        return sum(len(k) for seen in pending.values() for k, _ in seen)

    def emit(pending: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for model, [(keys, n)] in pending.items():
            for i in range(0, len(keys), 1 << 16):
                own = keys[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(own), model, np.int32)), "code": own, "n": n[i : i + (1 << 16)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, kept = {}, 0
        for batch in text_batches(batches):
            texts = batch["text"].to_pylist()
            for model, at in _parts(batch, place, folds, 0):
                pending.setdefault(model, []).append(np.unique(codes([texts[i] for i in at])[0], return_counts=True))
            if size(pending) > HELD_ENTRIES + 2 * kept:
                pending = merged(pending)
                kept = size(pending)
                if kept > HELD_ENTRIES:
                    yield from emit(pending)
                    pending, kept = {}, 0
        yield from emit(merged(pending))

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", folds: int = 1) -> tuple[list[str], DataFrame]:
    """Names of the models, and their entries (model, order, code, n, p, weight) from all texts; null texts are left out.

    The model of fold f of the i-th name is number i * folds + f.

    The LANGUAGES languages with the most rows have their own model, the rest and
    rows without a language share POOLED. A task sums its counts before the
    shuffle. Only the discounts, three numbers a model and order, reach the driver.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = pick(docs, text=text_col, lang=lang_col).where("text is not null").withColumn("fold", _fold(F.col("text"), folds))
    common = rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    languages = [r.lang for r in common.collect()]
    counts = rows.mapInArrow(_counter(languages, folds), "model int, code bigint, n bigint").groupBy("model", "code").agg(F.sum("n").alias("n"))
    levels = [saved(counts, "ngrams")]
    suffix = lambda order: F.col("code").bitwiseAND(F.lit((1 << UNIT * (order - 1)) - 1))
    for order in range(ORDER, 1, -1):  # lower orders count the different symbols before them
        levels.append(saved(levels[-1].groupBy("model", suffix(order).alias("code")).agg(F.count(F.lit(1)).alias("n")), "ngrams"))
    none = F.lit(None).cast("double")
    entries, lower = [], None
    for order in range(1, ORDER + 1):
        level = levels[ORDER - order]
        seen: dict[int, list[int]] = {}
        for r in level.groupBy("model").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).collect():
            seen[r["model"]] = [r[f"n{k}"] for k in range(1, 5)]
        d = spark.createDataFrame(
            [(m, *(float(x) for x in _discounts_from(n)[1:])) for m, n in seen.items()], "model int, d1 double, d2 double, d3 double"
        )
        context = F.shiftrightunsigned("code", UNIT).alias("context")
        kinds = [F.count_if(c).alias(f"n{k}") for k, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        contexts = level.groupBy("model", context).agg(F.sum("n").alias("total"), *kinds).join(F.broadcast(d), "model")
        contexts = contexts.withColumn("weight", F.expr("(d1 * n1 + d2 * n2 + d3 * n3) / total"))
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = level.withColumn("context", context).join(contexts.drop("n1", "n2", "n3"), ["model", "context"])
        if lower is None:
            joined = joined.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            joined = joined.withColumn("below", suffix(order)).join(lower, ["model", "below"])
        p = F.greatest(F.col("n") - own, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        level = saved(joined.select("model", F.lit(order).alias("order"), "code", "n", p.alias("p"), none.alias("weight")), "probabilities")
        back = contexts.select("model", F.lit(order - 1).alias("order"), F.col("context").alias("code"), F.col("total").alias("n"), none.alias("p"), "weight")
        entries += [level, back]
        lower = level.select("model", F.col("code").alias("below"), F.col("p").alias("lower"))
    table = entries[0]
    for more in entries[1:]:
        table = table.unionByName(more)
    # an n-gram and a context of the same symbols are one entry
    table = table.groupBy("model", "order", "code").agg(*[F.max(c).alias(c) for c in ("n", "p", "weight")])
    return [*languages, POOLED], saved(table, "entries")


def _at_least(entries: DataFrame, held: int) -> int:
    """The count that entries must reach so that at most ``held`` do."""
    low = 1
    for r in entries.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        held -= r["k"]
        if held < 0:
            low = r["n"] + 1
            break
    return low


def common(entries: DataFrame, low: int) -> dict[int, Model]:
    """Models with the entries counted at least ``low`` times."""
    table = entries.where(F.col("n") >= low).select("model", "order", "code", "p", "weight").toArrow()
    model, order, code, p, weight = (table[c].to_numpy() for c in table.column_names)
    out = {}
    for m in np.unique(model).tolist():
        at = np.flatnonzero(model == m)
        out[m] = Model.of(order[at], code[at].astype(np.int64).view(np.uint64), p[at], weight[at])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", held: int = HELD) -> dict[str, Model]:
    """A model of every language from all texts, with the ``held`` entries of all models counted most often."""
    names, entries = train(docs, text_col, lang_col)
    return {names[m]: model for m, model in common(entries, _at_least(entries, held)).items()}


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    found = words(texts)
    n, data = len(texts), found.data
    first = found.first
    byte_doc = np.repeat(np.arange(n), np.diff(found.offsets))
    starts = (data & 0xC0) != 0x80
    word_byte = np.zeros(len(data) + 1, np.int32)
    np.add.at(word_byte, found.start, 1)
    np.add.at(word_byte, found.end, -1)
    inside = np.cumsum(word_byte)[:-1] > 0
    marks = np.isin(data, np.frombuffer(MARKS.encode(), np.uint8))

    gram = grams(found.hash, 3)
    whole = found.doc[: len(gram)] == found.doc[2:] if len(gram) else np.zeros(0, bool)
    own = mix(gram[whole] + mix(found.doc[: len(gram)][whole].astype(np.uint64)))
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    at = np.flatnonzero(whole)[counts[inverse] > 1]
    covered = np.zeros(len(found.hash), bool)
    for k in range(3):
        covered[at + k] = True

    repeated = np.zeros(n, np.int64)
    for i, text in enumerate(texts.fill_null("").to_pylist()):
        lines = text.split("\n")
        if len(lines) > 1:
            full = [line for line in lines if line.strip(" \t\n\v\f\r")]
            repeated[i] = len(full) - len(set(full))
    return {
        "n_words": np.diff(first),
        "word_chars": np.bincount(byte_doc[starts & inside], minlength=n),
        "n_symbols": np.bincount(byte_doc[marks], minlength=n),
        "n_dup_lines": repeated,
        "n_repeat_words": np.bincount(found.doc[covered], minlength=n),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(languages: list[str], folds: int, present: set[int], whole: bool, shared):
    """Row number, doc_id, lang, counts, n-grams, the sum of the log probabilities of the common ones; the others and how often each occurs."""
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in text_batches(batches):
            n = batch.num_rows
            counted = text_counts(batch["text"])
            texts = batch["text"].to_pylist()
            grams_, total, of = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1, np.int32)
            rare_row, rare_code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for model, at in _parts(batch, place, folds, 1):
                if model not in present:
                    continue
                code, text = codes([texts[i] for i in at])
                if whole:
                    log_p = models[model].log_probability(code)
                else:
                    log_p = models[model].find(ORDER, code)[0] if model in models else np.full(len(code), np.nan)
                rare = np.isnan(log_p)
                of[at] = model
                grams_[at] = np.bincount(text, minlength=len(at))
                total[at] = np.bincount(text[~rare], log_p[~rare], len(at))
                rare_row.append(at[text[rare]])
                rare_code.append(code[rare])
            rows, code = np.concatenate(rare_row), np.concatenate(rare_code)
            order = np.lexsort((code, rows))
            rows, code = rows[order], code[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])][: len(rows)])
            offsets = pa.array(np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), batch["doc_id"], batch["lang"], *[pa.array(counted[c].astype(np.int64)) for c in COUNTS],
                    pa.array(of), pa.array(grams_), pa.array(total),
                    pa.ListArray.from_arrays(offsets, pa.array(code[new].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.r_[new, len(rows)]).astype(np.int32))),
                ],
                ["row", "doc_id", "lang", *COUNTS, "model", "grams", "log_p", "rare", "times"],
            )
            row += n

    return run


def _looked_up(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(model, code, p): log10 probability of each of the n-grams (model, code), by the longest part of it that has an entry."""
    out, lower = asked, []
    for order in range(ORDER, 0, -1):
        end = F.lit(-1 if order == ORDER else (1 << UNIT * order) - 1)
        own, context = F.col("code").bitwiseAND(end), F.shiftrightunsigned(F.col("code").bitwiseAND(end), UNIT)
        for k, code, value, name in ((order, own, "p", f"p{order}"), (order - 1, context, "weight", f"w{order}")):
            part = entries.where((F.col("order") == k) & F.col(value).isNotNull())
            part = part.select("model", F.col("code").alias("_code"), F.log10(F.greatest(value, F.lit(1e-12)) if name[0] == "w" else F.col(value)).alias(name))
            out = out.withColumn("_code", code).join(part, ["model", "_code"], "left").drop("_code")
    p = F.lit(float(-np.log10(SYMBOLS)))
    for order in range(1, ORDER + 1):
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"w{order}"), F.lit(0.0)) + p)
    return out.select("model", "code", p.alias("p"))


def measure(
    docs: DataFrame, names: list[str], entries: DataFrame, folds: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = HELD
) -> DataFrame:
    """One row per document: doc_id, lang, the counts, and log_perplexity (log10; null for a null text and without a model).

    ``names`` and ``entries`` are those of ``train`` with as many folds. N-grams that
    are not among the ``held`` entries are looked up in joins, each different one once.
    """
    spark = bounded_batches(docs.sparkSession)
    low = _at_least(entries, held)
    present = {r["model"] for r in entries.select("model").distinct().collect()}
    shared = spark.sparkContext.broadcast(common(entries, low))
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("fold", _fold(F.col("text"), folds))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    schema = f"row bigint, doc_id {kinds['doc_id']}, lang {kinds['lang']}, {counts}, model int, grams bigint, log_p double, rare array<bigint>, times array<int>"
    read = saved(rows.mapInArrow(_measured(names[:-1], folds, present, low == 1, shared), schema), "measured")
    asked = read.select("row", "model", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    asked = asked.select("row", "model", F.col("x.rare").alias("code"), F.col("x.times").alias("times"))
    known = _looked_up(asked.select("model", "code").distinct(), entries)
    found = asked.join(known, ["model", "code"]).groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("more"))
    total = F.col("log_p") + F.coalesce("more", F.lit(0.0))
    score = F.when(F.col("grams") > 0, -total / F.col("grams")).alias("log_perplexity")
    return read.drop("rare", "times").join(found, "row", "left").select("doc_id", "lang", *COUNTS, score)


def judge(measured: DataFrame) -> DataFrame:
    """The rows with base_failed, perplexity_low, perplexity_high and kept added.

    ``measured`` is read twice, so it should be a saved table. Bands come from
    the quartiles of the documents that pass the base rules; a language without
    such a document has no band and rejects nothing. A text of no words fails the base rules.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed)
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = (
        rows.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
        .groupBy(F.col("lang").alias("_lang"))
        .agg(quartiles.alias("_q"))
        .withColumn("_w", F.greatest(F.lit(SPREADS) * (F.col("_q")[2] - F.col("_q")[0]), F.lit(LEAST_WIDTH)))
        .select("_lang", (F.col("_q")[1] - F.col("_w")).alias("_low"), (F.col("_q")[1] + F.col("_w")).alias("_high"))
    )
    out = rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    fits = F.col("_low").isNull() | F.col("log_perplexity").isNull() | F.col("log_perplexity").between(F.col("_low"), F.col("_high"))
    ten = F.lit(10.0)
    return out.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & fits).alias("kept"), F.pow(ten, "log_perplexity").alias("perplexity"),
        F.pow(ten, "_low").alias("perplexity_low"), F.pow(ten, "_high").alias("perplexity_high"),
    )


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on all texts and judge them: one row per document.

    A null or empty text has no words and fails the base rules. Repeated rows
    count as often as they are there and each get a row; no rows give no rows.
    """
    names, entries = train(docs, text_col, lang_col, FOLDS)
    return judge(saved(measure(docs, names, entries, FOLDS, id_col, text_col, lang_col), "quality"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op7: counts, base rules and verdict of all documents."""
    return rules(documents(spark, folder))
