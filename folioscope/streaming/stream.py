"""Sync decisions on a stream of revisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.sources.files import is_folder, shared_folder

REVISION = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def revisions(spark: SparkSession, folder: str, table: str = "events.parquet") -> DataFrame:
    """A stream of revisions from the files of a table of events, a folder or one file: doc_id, version, status, ts."""
    stream = spark.readStream.schema(REVISION)
    if is_folder(spark, f"{folder}/{table}"):
        return revision_columns(stream.parquet(f"{folder}/{table}"))
    return revision_columns(stream.option("pathGlobFilter", table).parquet(folder))


def revision_columns(events: DataFrame) -> DataFrame:
    return events.select((F.col("event_id") % 1000).alias("doc_id"), F.col("event_id").cast("string").alias("version"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), "ts")


ACTION = "doc_id long, version string, status string, action string, seen string"


#: State of a document that had no revision for so long goes.
KEPT_FOR = 30 * 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Decisions(StatefulProcessor):
    """Actions of each document's new revisions; the state is its last synced version, which moves on success only.

    The state expires once a document had no success for `kept_for` milliseconds; a revision after that is a first sync again.
    """

    def __init__(self, kept_for: int = KEPT_FOR):
        self.kept_for = kept_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version string", self.kept_for)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers) -> None:  # noqa: N802
        self.seen.update((str(initial["version"].iloc[0]),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen = self.seen.get()[0] if self.seen.exists() else None
        df = pd.concat(list(rows)).sort_values("ts", kind="stable")
        good = df["version"].where(df["status"] == "success")
        before = good.shift().ffill()
        before = before.where(before.notna(), seen)
        action = np.select([df["status"] == "error", before.isna(), before == df["version"]], ["error", "first-sync", "up-to-date"], "fast-forward")
        if good.notna().any():
            self.seen.update((good.dropna().iloc[-1],))
        yield pd.DataFrame({"doc_id": key[0], "version": df["version"], "status": df["status"], "action": action, "seen": before.where(before.notna(), None)})

    def close(self) -> None:
        pass


def stream_sync_action(stream: DataFrame, synced: DataFrame | None = None, kept_for: int = KEPT_FOR) -> DataFrame:
    """An action for each revision as it arrives, with state kept by document across batches, and across runs from one checkpoint.

    synced (doc_id, version) is the state to begin with. State is in RocksDB stores, which this kind of state needs: the
    session's setting for new streams is changed to it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    start = None if synced is None else synced.select("doc_id", "version").groupBy("doc_id")
    return stream.groupBy("doc_id").transformWithStateInPandas(Decisions(kept_for), ACTION, "Append", "ProcessingTime", initialState=start)


def stream_run_summary(stream: DataFrame, window: str = "300 seconds", late: str = "600 seconds") -> DataFrame:
    """start, status, n: totals of each window; a window is given out once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def drained(stream: DataFrame, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """All that a stream over files has to give now: one run that ends when the input is used up.

    Rows and the stream's state go to the shared folder; a run over the folder of an earlier one goes on from there. With keys,
    rows are updates and the last of each key counts.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    run = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    # state that expires would ask for empty batches without end
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        if keys is None:
            run.outputMode("append").format("parquet").start(f"{folder}/rows").awaitTermination()
            return spark.read.parquet(f"{folder}/rows")
        run.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(empty, before)
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def stream_with_mappings(stream: DataFrame, read_mappings: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None]) -> None:
    """Each batch is joined with the mappings as they are then; where they cannot be read, with the last ones."""
    last: list[DataFrame] = []

    def each(batch: DataFrame, number: int) -> None:
        try:
            last[:] = [read_mappings(batch.sparkSession)]
        except AnalysisException:
            if not last:
                raise
        sink(batch.join(last[0], "doc_id", "left"), number)

    state = shared_folder(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
