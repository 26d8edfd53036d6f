"""Structured Streaming forms of the batch operators.

Every job can run with ``availableNow`` (process what is there, then stop), so
its result can be compared to the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelark.operators import drift
from panelark.operators.quality import session_issues
from panelark.operators.rows import last_rows
from panelark.schema import BAR_ALIASES
from panelark.session import cut_lineage
from panelark.sources.files import bar_columns, symbol_of_file


def bar_stream(spark: SparkSession, path: str, header: Sequence[str], files_per_trigger: int = 1000) -> DataFrame:
    """Bars from CSV files as they arrive; ``header`` is the column order of the files."""
    names = [h.strip().lower().replace(" ", "_") for h in header]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    none = F.lit(None).cast("string")
    text = {
        n: F.coalesce(*[F.col(a) for a in aliases if a in names], none) for n, aliases in BAR_ALIASES.items()
    }
    return raw.select(*bar_columns(text, symbol_of_file(F.col("_metadata.file_name"))))


def tick_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling bars from (symbol, ts, value) ticks. Rows later than ``delay`` are dropped.

    In append mode a bar comes out once, when it is closed; ``live_bars`` also
    shows the open ones.
    """
    timed = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", width), "symbol")
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            F.max("ts").alias("last_tick"),
        )
        .select(
            "symbol",
            F.col("window.start").cast("timestamp_ntz").alias("timestamp"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            F.col("last_tick").cast("timestamp_ntz").alias("last_tick"),
        )
    )


def live_bars(bars: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each version of a bar as its ticks come in, open bars included.

    Every micro-batch has a folder of its own, so one that runs again replaces
    what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        bars.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_bars(spark: SparkSession, out: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The last version of each bar of ``live_bars``, with the number of versions.

    ``final`` bars end at or before the last tick of all less the delay. The
    stream must have handled a micro-batch.
    """
    versions = spark.read.parquet(out)
    count = versions.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("versions"))
    last = last_rows(versions, 1, ["symbol", "timestamp"], "batch").drop("batch")
    # one row
    seen = F.broadcast(versions.agg(F.max("last_tick").alias("_seen")))
    final = F.col("timestamp") + F.expr(f"INTERVAL {width}") <= F.col("_seen") - F.expr(f"INTERVAL {delay}")
    return last.join(count, ["symbol", "timestamp"]).join(seen).withColumn("final", final).drop("_seen")


def first_writes(signals: DataFrame, keys: Sequence[str], time: str, delay: str = "7 days") -> DataFrame:
    """Append-only signal rows: a key already seen within the delay is dropped."""
    timed = signals.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = (
    "symbol string, timestamp timestamp, value double, ewm double, peak double, drawdown double, paused boolean, late boolean"
)


class RunningState(StatefulProcessor):
    """Exponential mean, running peak, sticky pause flag and last time of one symbol, kept in a state store.

    A row no later than the last one of an earlier batch cannot be folded in any
    more: it is passed on with ``late`` set and changes nothing.
    """

    def __init__(self, alpha: float, limit: float):
        self.alpha, self.limit = alpha, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "ewm double, peak double, paused boolean, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  names of the API
        batch = pd.concat(list(rows)).sort_values("timestamp", kind="stable").reset_index(drop=True)
        known = self.state.get() if self.state.exists() else None
        late = batch["timestamp"] <= pd.Timestamp(known[3]) if known else pd.Series(False, batch.index)
        out = batch[["symbol", "timestamp", "value"]].assign(ewm=np.nan, peak=np.nan, drawdown=np.nan, paused=None, late=late)
        own = batch[~late]
        if len(own):
            values = own["value"].to_numpy(float)
            # the state stands before the batch as one more value
            before = np.r_[known[0] if known else values[0], values]
            means = pd.Series(before).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
            peaks = np.maximum.accumulate(np.r_[known[1] if known else values[0], values])[1:]
            falls = np.where(peaks != 0, values / np.where(peaks != 0, peaks, 1.0) - 1.0, 0.0)
            paused = np.logical_or.accumulate(np.r_[bool(known and known[2]), falls <= -abs(self.limit)])[1:]
            out.loc[~late, ["ewm", "peak", "drawdown"]] = np.column_stack([means, peaks, falls])
            out.loc[~late, "paused"] = paused
            self.state.update((float(means[-1]), float(peaks[-1]), bool(paused[-1]), own["timestamp"].iloc[-1].to_pydatetime()))
        yield out

    def close(self) -> None:
        pass


def running_state(rows: DataFrame, alpha: float = 0.1, limit: float = 0.10) -> DataFrame:
    """Per symbol: exponential mean, running peak and a sticky pause flag, kept across batches.

    Rows are (symbol, timestamp, value). State is four numbers a symbol in a
    RocksDB store, so it may outgrow the executors' memory.
    """
    rows.sparkSession.conf.set(*STATE_STORE)
    typed = rows.select("symbol", F.col("timestamp").cast("timestamp").alias("timestamp"), "value")
    return typed.groupBy("symbol").transformWithStateInPandas(
        RunningState(alpha, limit), T.StructType.fromDDL(OUTPUT), "append", "None"
    )


def monitor(bars: DataFrame, reference: DataFrame, features: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Validate the latest session of each micro-batch and gate the batch on drift.

    Two things are kept across batches: the value counts of the reference, made
    once, and the last bar of every symbol, so that a price gap between two batches
    is seen. The bars lie in one of two folders in turn; a batch that is run again
    finds those of the batch before it untouched.
    """
    known = cut_lineage(drift.value_counts(reference, features))

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        seen = batch
        if batch_id > 0:
            seen = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out}-last/{(batch_id - 1) % 2}"))
        last_rows(seen, 1).write.mode("overwrite").parquet(f"{out}-last/{batch_id % 2}")
        gate = drift.gate_of(drift.paired(known, drift.value_counts(batch, features)))
        report = session_issues(seen, per_session=True).where(F.col("timestamp") == batch.agg(F.max("timestamp")).scalar())
        report = report.select(
            F.lit(batch_id).alias("batch_id"), "timestamp", "symbols", "gaps", "largest_gap", "valid",
            F.size("reasons").alias("n_reasons"), gate.select("status").scalar().alias("drift_status"),
        )
        # one folder per batch, so a replayed batch replaces its own report
        report.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return (
        bars.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
