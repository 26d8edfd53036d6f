"""Pipeline over documents: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelark.llm import bpe, decontamination, jaccard, language_id, secrets
from panelark.llm.common import documents, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token ids, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language_id.stage),  # documents in no learned language go
    ("near duplicates", jaccard.stage),  # one document of each group stays
    ("decontamination", decontamination.stage),  # documents with a benchmark passage go
    ("secrets", secrets.stage),  # secrets are replaced in the text
    ("tokens", tokens),
]

# A trained model, an index and a tokenizer are among the stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again by the next stage."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{i}")
    return docs
