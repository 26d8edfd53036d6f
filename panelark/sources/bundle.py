"""Saved production model: fitted pipeline, metadata and the value counts of its training rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from panelark.schema import ONE_WAY_BPS, TARGET


@dataclass
class Metadata:
    feature_cols: list[str]
    target_col: str = TARGET
    timestamp_col: str = "timestamp"
    train_end: str = ""
    max_names: int = 10
    max_weight: float = 0.05
    gross_exposure: float = 1.0
    cost_bps: float = ONE_WAY_BPS
    max_drawdown_pause: float = 0.10
    execution: str = "next_open"


@dataclass
class Bundle:
    model: PipelineModel
    meta: Metadata
    reference: DataFrame = field(repr=False)  # (feature, x, n) over all labelled rows


def save_bundle(bundle: Bundle, folder: str) -> None:
    spark = bundle.reference.sparkSession
    bundle.model.write().overwrite().save(f"{folder}/model")
    ranged = bundle.reference.repartitionByRange("feature", "x").sortWithinPartitions("feature", "x")
    ranged.write.mode("overwrite").parquet(f"{folder}/reference")
    text = [(json.dumps(asdict(bundle.meta)),)]
    spark.createDataFrame(text, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    text = spark.read.text(f"{folder}/metadata").first()[0]
    meta = Metadata(**json.loads(text))
    return Bundle(PipelineModel.load(f"{folder}/model"), meta, spark.read.parquet(f"{folder}/reference"))
