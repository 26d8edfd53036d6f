"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A letter trigram is bound
from its three letters' vectors, permuted by place (rotated by two, one and
no places) and multiplied. A text is the bundle (sum) of its trigrams' vectors,
a language the bundle of its training texts; a text gets the language with the
largest cosine.

Letters fold to 64 classes: a break (anything that is no letter), a-z, and 37
classes for all others by their code point. Bundling is linear, so training
gathers only trigram counts per language, at most 64^3 rows each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import bounded_batches, documents, pick
from panelark.llm.words import text_batches

SIZE = 512  # components of a vector
CLASSES = 64
BREAK = 0
UNKNOWN = "und"
HELD_LANGUAGES = 64  # languages whose counts a task holds at once


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (CLASSES, SIZE))


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if (letter := chr(code)).isalpha():
            low = ord(letter.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low * 0x9E3779B1 % (1 << 32) * 37 // (1 << 32)
    return table


class Vectors:
    """Trigram vectors, made when first asked for."""

    def __init__(self):
        self.table = np.empty((CLASSES**3, SIZE), np.int8)  # pages are taken when touched
        self.made = np.zeros(CLASSES**3, bool)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        new = codes[~self.made[codes]]
        if len(new):
            letters = letter_vectors()
            first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
            self.table[new] = first[new // CLASSES**2] * second[new // CLASSES % CLASSES] * letters[new % CLASSES]
            self.made[new] = True
        return self.table[codes].astype(np.float32)


@functools.cache
def vectors() -> Vectors:
    return Vectors()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and code of each trigram, and whether each text has a letter.

    A text starts and ends with a break; neighbouring breaks count once.
    """
    codes = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = classes()[codes].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    same = text[1:] == text[:-1]
    keep = np.ones(len(symbol), bool)
    keep[1:] = ~((symbol[1:] == BREAK) & (symbol[:-1] == BREAK) & same)
    symbol, text = symbol[keep], text[keep]
    lettered = np.bincount(text[symbol != BREAK], minlength=len(texts)) > 0
    code = (symbol[:-2] * CLASSES + symbol[1:-1]) * CLASSES + symbol[2:]
    inside = text[:-2] == text[2:]
    return text[:-2][inside], code[inside], lettered


class Profiles(NamedTuple):
    languages: list[str]
    vectors: np.ndarray  # one unit row per language


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(at), pa.string()), "code": pa.array(at, pa.int32()), "n": counts[at]}
            )
        held.clear()

    for batch in text_batches(batches):
        langs = batch["lang"].to_pylist()
        text, code, _ = trigrams(batch["text"].to_pylist())
        for lang in dict.fromkeys(langs):
            own = np.array([x == lang for x in langs])
            if lang not in held:
                if len(held) >= HELD_LANGUAGES:
                    yield from rows()
                held[lang] = np.zeros(CLASSES**3, np.int64)
            held[lang] += np.bincount(code[own[text]], minlength=CLASSES**3)
    yield from rows()


def _bundle(counts: pd.DataFrame) -> pd.DataFrame:
    total = counts["n"].to_numpy(np.float32) @ vectors()[counts["code"].to_numpy(np.int64)]
    return pd.DataFrame({"lang": [counts["lang"].iloc[0]], "vector": [total.astype(float).tolist()]})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages of all given texts; rows with a null text or language are left out.

    One pass; counts are summed in each task before the shuffle. What reaches
    the driver is one vector per language. No rows give no languages.
    """
    bounded_batches(docs.sparkSession)
    known = pick(docs, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    counts = known.mapInArrow(_count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    made = counts.groupBy("lang").applyInPandas(_bundle, "lang string, vector array<double>").orderBy("lang").collect()
    unit = np.array([r.vector for r in made], np.float32).reshape(-1, SIZE)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return Profiles([r.lang for r in made], unit)


DOCS_AT_ONCE = 128


def cosines(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text with each profile, and whether it has a letter."""
    text, code, lettered = trigrams(texts)
    out = np.zeros((len(texts), len(profiles.languages)), np.float32)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(0, len(texts), DOCS_AT_ONCE):
        j = min(len(texts), i + DOCS_AT_ONCE)
        own = slice(ends[i], ends[j])
        distinct, column = np.unique(code[own], return_inverse=True)
        cells = np.bincount((text[own] - i) * len(distinct) + column, minlength=(j - i) * len(distinct))
        bundled = cells.reshape(j - i, len(distinct)).astype(np.float32) @ vectors()[distinct]
        norm = np.linalg.norm(bundled, axis=1, keepdims=True)
        out[i:j] = (bundled / np.maximum(norm, 1e-9)) @ profiles.vectors.T
    return out, lettered


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred and score, the largest cosine (negative ones count as 0).

    A null text, a text without a letter and any text when nothing was learned
    get ``und`` and score 0. Ties go to the language that sorts first. Repeated
    rows each get their row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = batch["text"].fill_null("").to_pylist()
            if profiles.languages:
                cosine, lettered = cosines(texts, profiles)
                best, score = cosine.argmax(1), np.clip(cosine.max(1), 0, 1)
                langs = [profiles.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, score, 0)
            else:
                langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(langs, pa.string()), pa.array(score.astype(float))], ["doc_id", "lang_pred", "score"]
            )

    bounded_batches(docs.sparkSession)
    picked = pick(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op9: languages of all documents, learned from those outside fold 2 of 4."""
    docs = documents(spark, folder)
    profiles = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


# A text less like any profile is in no language that was learned. A few words are unlike any profile
# in any language, so short texts are not judged by their score.
MIN_SCORE, JUDGED_CHARS = 0.15, 200


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline: keep the documents whose text is in a learned language.

    Judges rows by their text, so that repeated or missing ids don't matter.
    """
    profiles = fit(docs)
    near = (F.col("_score") >= MIN_SCORE) | (F.length("text") < JUDGED_CHARS)
    return with_language(docs, profiles).where((F.col("_lang") != UNKNOWN) & near).select(*docs.columns)


def with_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows with ``_lang`` and ``_score`` added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text_col):
            texts = batch[text_col].fill_null("").to_pylist()
            cosine, lettered = cosines(texts, profiles)
            if not profiles.languages:
                cosine, lettered = np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
            langs = [profiles.languages[b] if ok else UNKNOWN for b, ok in zip(cosine.argmax(1), lettered, strict=True)]
            added = [pa.array(langs, pa.string()), pa.array(np.clip(cosine.max(1), 0, 1).astype(float))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_lang", "_score"])

    bounded_batches(docs.sparkSession)
    schema = docs.select("*", F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema
    return docs.mapInArrow(run, schema)
