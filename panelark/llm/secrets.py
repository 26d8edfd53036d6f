"""Secrets in texts: three fixed patterns, and random-looking strings by character Markov models.

Everything here is DataFrame and SQL functions.

A candidate string is scored by the mean log-likelihood ratio of its character
pairs under two first-order Markov models, one of random strings and one of
ordinary identifiers. Both are add-one smoothed counts of character pairs in
labelled samples. The tables are 67 x 67 numbers whatever the corpus, and are
put into the query as one constant array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import documents, pick

# Fixed values of the contract: kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a run is one match, so its least length may stand in the pattern
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = [kind for kind, *_ in BASE] + ["random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"
SAMPLE_DOCS = 20_000  # documents, about, that labelled samples are taken from
MIN_RATIO = 0.5  # mean log-likelihood ratio per pair from which a candidate is a secret

SPAN = "struct<start:int,end:int,value:string>"


def _found(text: str, pattern: str) -> Column:
    """Spans of all matches, leftmost and non-overlapping, in code points.

    A split by the same pattern gives the texts between the matches, so places
    follow from lengths. Texts without a match are scanned once.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""
      CASE WHEN {text} RLIKE '{quoted}' THEN aggregate(
        zip_with(regexp_extract_all({text}, '{quoted}', 0), split({text}, '{quoted}', -1),
                 (m, gap) -> named_struct('m', m, 'gap', gap)),
        named_struct('at', 0, 'spans', CAST(array() AS array<{SPAN}>)),
        (s, x) -> CASE WHEN x.m IS NULL THEN s ELSE named_struct(
          'at', s.at + length(x.gap) + length(x.m),
          'spans', concat(s.spans, array(named_struct(
            'start', s.at + length(x.gap), 'end', s.at + length(x.gap) + length(x.m), 'value', x.m)))) END,
        s -> s.spans) END""")


def _pairs(value: str) -> str:
    """SQL for the array of pair numbers of a string's characters; pairs with a character outside the alphabet are left out."""
    place = f"transform(regexp_extract_all({value}, '(?s).', 0), c -> locate(c, '{ALPHABET}'))"
    return f"""filter(transform(array({place}), p -> zip_with(slice(p, 1, greatest(size(p) - 1, 0)), slice(p, 2, greatest(size(p) - 1, 0)),
        (a, b) -> IF(a = 0 OR b = 0, -1, (a - 1) * {len(ALPHABET)} + b - 1)))[0], x -> x >= 0)"""


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings (value, random) from about ``sample_docs`` documents, chosen by a hash of their text.

    What the base patterns take for secrets is labelled random; identifiers in
    the rest of the same texts are labelled ordinary.
    """
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(total, 1))) < sample_docs) if total > sample_docs else docs
    everything = "|".join(f"(?:{pattern})" for _, pattern, *_ in BASE)
    labelled = part.select(
        F.array_union(F.regexp_extract_all("text", F.lit(BASE[1][1]), F.lit(0)), F.regexp_extract_all("text", F.lit(BASE[2][1]), F.lit(0))).alias("a"),
        F.expr(f"transform({_matches(BASE[0][1])}, m -> m)").alias("b"),
        F.regexp_extract_all(F.regexp_replace("text", everything, " "), F.lit(IDENTIFIER), F.lit(0)).alias("c"),
    )
    secret = labelled.select(F.explode(F.concat("a", F.filter("b", lambda v: F.length(v) >= 12))).alias("value"), F.lit(True).alias("random"))
    return secret.union(labelled.select(F.explode("c"), F.lit(False)))


def _matches(pattern: str) -> str:
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract_all(text, '{quoted}', 1)"


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character pair, from labelled strings (value, random).

    At most 2 x 67 x 67 counts reach the driver. Without samples of a kind, its
    model is uniform.
    """
    counted = samples.select("random", F.expr(f"explode({_pairs('value')})").alias("pair")).groupBy("random", "pair").count()
    n = len(ALPHABET)
    counts = {True: [0] * (n * n), False: [0] * (n * n)}
    for row in counted.collect():
        counts[row["random"]][row["pair"]] = row["count"]

    def log_p(table: list[int], pair: int) -> float:
        first = pair // n * n
        return math.log((table[pair] + 1) / (sum(table[first : first + n]) + n))

    return [round(log_p(counts[True], p) - log_p(counts[False], p), 4) for p in range(n * n)]


def _ratio(value: str, model: list[float]) -> str:
    table = f"CAST(split('{','.join(map(str, model))}', ',') AS array<double>)"
    return f"""aggregate(transform(array({_pairs(value)}), q -> aggregate(q, 0D, (s, k) -> s + {table}[k]) / greatest(size(q), 1)), 0D, (s, x) -> s + x)"""


def scan(docs: DataFrame, model: list[float], text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows with ``_base`` and ``_all`` added: arrays of (start, kind, end), ordered by start, then kind.

    ``kind`` is the place in KINDS. A null or empty text has no spans. A
    candidate that overlaps a base span is not added. Each row stands for itself,
    so repeated rows are no matter.
    """
    work = docs.withColumn("_t", F.coalesce(docs[text_col], F.lit("")))
    for k, (_, pattern, _group, _least) in enumerate(BASE):
        work = work.withColumn(f"_k{k}", _found("_t", pattern))
    work = work.withColumn("_k3", _found("_t", CANDIDATE))
    quoted = BASE[0][1].replace("\\", "\\\\").replace("'", "\\'")
    kept = [f"filter(_k0, x -> length(regexp_extract(x.value, '{quoted}', 1)) >= {BASE[0][3]})", "_k1", "_k2"]
    empty = "CAST(array() AS array<struct<start:int,kind:int,end:int>>)"
    bare = [f"coalesce(transform({a}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end)), {empty})" for k, a in enumerate(kept)]
    work = work.withColumn("_base", F.expr(f"array_sort(concat({', '.join(bare)}))"))
    alone = "NOT exists(_base, b -> b.start < x.end AND x.start < b.end)"
    added = f"filter(_k3, x -> {alone} AND {_ratio('x.value', model)} >= {min_ratio})"
    work = work.withColumn(
        "_all",
        F.expr(f"array_sort(concat(_base, coalesce(transform({added}, x -> named_struct('start', x.start, 'kind', 3, 'end', x.end)), {empty})))"),
    )
    return work.drop("_t", "_k0", "_k1", "_k2", "_k3")


def _written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)))")


def report(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    spans = scan(pick(docs, doc_id=id_col, text=text_col), model)
    count = [
        F.expr(f"CAST(size(filter(_all, x -> x.kind = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    return spans.select("doc_id", *count, F.sha2(_written("_base"), 256).alias("base_sha256"), _written("_all").alias("spans"))


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The rows with every span replaced by a mark; overlapping spans get one. Null stays null."""
    safe = mark.replace("'", "\\'")
    cut = f"""aggregate(_all, named_struct('at', 0, 'out', ''),
        (s, x) -> named_struct('at', greatest(s.at, x.end),
          'out', IF(x.start < s.at, s.out, concat(s.out, substring(`{text_col}`, s.at + 1, x.start - s.at), '{safe}'))),
        s -> concat(s.out, substring(`{text_col}`, s.at + 1, length(`{text_col}`))))"""
    out = scan(docs, model, text_col).withColumn(text_col, F.expr(f"IF(size(_all) = 0, `{text_col}`, {cut})"))
    return out.select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op4: secrets in all documents, by patterns and by models trained on labelled samples."""
    docs = documents(spark, folder)
    return report(docs, fit(labelled_samples(docs)))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline: secrets are replaced in the texts; every document stays, with its length as it now is."""
    out = redact(docs, fit(labelled_samples(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
