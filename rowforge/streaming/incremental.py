"""Statistics, progress and publication kept up to date by micro-batches."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rowforge.operators import moments
from rowforge.operators.ranking import positions
from rowforge.sources import snapshots
from rowforge.sources.tables import is_complete, scratch


def merge_batch(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch's array states in a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moments.states(batch, keys).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def merged_state(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """(keys, pos, n, mean, m2, low, high) of all micro-batches."""
    return moments.by_position(moments.merged(spark.read.parquet(folder).drop("batch"), keys), keys)


def incremental_stats(vectors: DataFrame, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of vectors `v` to its end and merge its states."""
    keys = keys or []
    spark = vectors.sparkSession
    folder = scratch(spark)
    query = vectors.writeStream.foreachBatch(merge_batch(f"{folder}/state", keys)).option("checkpointLocation", checkpoint or f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged_state(spark, f"{folder}/state", keys)


def progress(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, n, done): counts by tumbling windows of ts; with `late` a watermark, for streams."""
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done")).select(
        F.col("w.start").alias("start"), "n", "done"
    )


class RowProgress(StreamingQueryListener):
    """Counters of a stream's observed rows: one for every `rows` rows and one where `seconds` have passed, and the rest when it ends.

    The stream has `observed(df, name)` in it. A counter is (kind, batch, rows, done, processed):
    what came since the counter before, and all so far. Spark tells of a micro-batch when it has
    ended, so a counter stands for the micro-batch in which its interval was full. A batch that
    is told twice counts once. `emit` gets each counter as it comes; `counters` keeps them.
    """

    def __init__(self, name: str, *, rows: int, seconds: float = 60.0, emit: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.monotonic):
        super().__init__()
        self.name, self.rows, self.seconds, self.emit, self.clock = name, rows, seconds, emit, clock
        self.counters: list[dict] = []
        self.seen, self.done, self.told, self.told_done, self.batch = 0, 0, 0, 0, -1
        self.last, self.ended = clock(), threading.Event()

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        self._if_late()

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is None or event.progress.batchId <= self.batch:
            return
        self.add(event.progress.batchId, found["rows"], found["done"])

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        if self.seen > self.told:
            self._tell("end")
        self.ended.set()

    def add(self, batch: int, rows: int, done: int) -> None:
        full = self.seen // self.rows
        self.batch, self.seen, self.done = batch, self.seen + rows, self.done + done
        if self.seen // self.rows > full:
            self._tell("rows")
        else:
            self._if_late()

    def _if_late(self) -> None:
        if self.seen > self.told and self.clock() - self.last >= self.seconds:
            self._tell("time")

    def _tell(self, kind: str) -> None:
        counter = {"kind": kind, "batch": self.batch, "rows": self.seen - self.told, "done": self.done - self.told_done, "processed": self.seen}
        self.told, self.told_done, self.last = self.seen, self.done, self.clock()
        self.counters.append(counter)
        if self.emit:
            self.emit(counter)


def observed(df: DataFrame, name: str | Observation, done: Column) -> DataFrame:
    """df with counters of its rows, and of those where `done` holds, which an Observation or a listener gets; no pass of their own."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("done"))


def run_with_progress(df: DataFrame, done: Column, folder: str, *, rows: int, seconds: float = 60.0, emit: Callable[[dict], None] | None = None, wait: float = 60.0) -> list[dict]:
    """Write df, a stream or not, to folder/out and return its counters. A batch job has one, when it has ended."""
    spark = df.sparkSession
    if not df.isStreaming:
        watch = Observation("progress")
        observed(df, watch, done).write.parquet(f"{folder}/out")
        one = {"kind": "end", "batch": 0, "rows": watch.get["rows"], "done": watch.get["done"], "processed": watch.get["rows"]}
        if emit:
            emit(one)
        return [one]
    name = f"progress_{uuid.uuid4().hex}"
    listener = RowProgress(name, rows=rows, seconds=seconds, emit=emit)
    spark.streams.addListener(listener)
    try:
        query = observed(df, name, done).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
        if not listener.ended.wait(wait):
            raise TimeoutError(f"no word of the stream's end in {wait} s")
    finally:
        spark.streams.removeListener(listener)
    return listener.counters


def counters_by_rows(df: DataFrame, order: str, every: int, done: Column) -> DataFrame:
    """(upto, rows, done): what a table's counters are, `every` rows in the order of a number each, and the rest; no task sees all rows."""
    placed = positions(df.withColumn("__done", done), order, "__i")
    total = placed.agg(F.count("*").alias("__n"))
    upto = F.least((F.floor(F.col("__i") / every) + 1) * every, F.col("__n"))
    return placed.crossJoin(F.broadcast(total)).groupBy(upto.alias("upto")).agg(F.count("*").alias("rows"), F.count_if("__done").alias("done"))


def finalise_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> bool:
    """Write unless a finished result is there; True when this call wrote it.

    Rows are staged beside it and renamed when they are whole, so a reader never sees a part of
    them; of two writers the later one finds the first one's result. What an older writer left
    there unfinished is removed before.
    """
    if is_complete(spark, path):
        return False
    staged = f"{path}_staged-{uuid.uuid4().hex}"
    build().write.parquet(staged)
    if is_complete(spark, path):
        snapshots.remove(spark, staged)
        return False
    snapshots.remove(spark, path)
    return snapshots.renamed(spark, staged, path)


def completed_once(completions: DataFrame, key: str, at: str, within: str = "3650 days") -> DataFrame:
    """The first completion that arrives for each key, of a stream that repeats them; what is known of a key is forgotten once `at` is `within` later."""
    return completions.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def follow_completions(portions: list[DataFrame], key: str, at: str, folder: str, within: str = "3650 days") -> DataFrame:
    """Completed work as a table: a stream that finds the portions one after another, with a restart between them; no restart or repetition counts twice."""
    spark = portions[0].sparkSession
    for i, part in enumerate(portions):
        part.write.parquet(f"{folder}/in/{i}")
        live = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        query = completed_once(live, key, at, within).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def pending(all_work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_work.join(done.select(key), key, "left_anti")
