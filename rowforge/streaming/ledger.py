"""Leases of shards as keyed state: claims, expiry, fenced completion; the same rules for a stream and for a batch."""

from __future__ import annotations

import heapq
import itertools
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a claim holds.
LEASE = 7200
OUT = "shard long, event_id long, action string, owner string, accepted boolean, status string, attempts long, gen long, expiry long"
#: Events of a shard that a streaming task sorts in memory, and rows that it passes on or reads back at once.
RUN = 200_000
BATCH = 10_000
#: Events of a shard, at most, that are sorted as plain values.
FEW = 2000
STATE = "status string, owner string, expiry long, attempts long, gen long"


class Ledger:
    """One shard's lease. A claim needs an available shard or an ended lease; completion the current owner and generation."""

    def __init__(self, status: str = "available", owner: str | None = None, expiry: int = 0, attempts: int = 0, gen: int = 0, lease: int = LEASE):
        self.status, self.owner, self.expiry, self.attempts, self.gen, self.lease = status, owner, expiry, attempts, gen, lease

    def claim(self, owner: str, now: int) -> bool:
        if not (self.status == "available" or (self.status == "claimed" and self.expiry < now)):
            return False
        self.status, self.owner, self.expiry = "claimed", owner, now + self.lease
        self.attempts += 1
        self.gen += 1
        return True

    def complete(self, owner: str, gen: int | None) -> bool:
        if self.status != "claimed" or self.owner != owner or self.gen != gen:
            return False
        self.status = "done"
        return True

    def row(self) -> tuple:
        return self.status, self.owner, self.expiry, self.attempts, self.gen


def apply_events(ledger: Ledger, shard: int, events: Iterable[Any]) -> Iterator[tuple]:
    """Events with event_id, action, owner, at (seconds) and gen, in order. A completion without a generation is rejected: it can't be told from a late one."""
    for e in events:
        gen = None if pd.isna(e.gen) else int(e.gen)
        ok = ledger.claim(e.owner, int(e.at)) if e.action == "claim" else ledger.complete(e.owner, gen)
        yield shard, int(e.event_id), e.action, e.owner, ok, ledger.status, ledger.attempts, ledger.gen, ledger.expiry


_FIELDS = ["event_id", "action", "owner", "at", "gen"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


class Event(NamedTuple):
    event_id: int
    action: str
    owner: str | None
    at: int
    gen: int | None


def _batched(rows: Iterable[tuple], size: int = BATCH) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield part


def replay(events: DataFrame, lease: int = LEASE) -> DataFrame:
    """Each event with its verdict and the shard's state after it. A task sorts its events by Spark, with spill, and holds one batch and one shard's lease."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in OUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ledger = None, Ledger(lease=lease)
        for b in batches:
            out: list[tuple] = []
            for key, *fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != shard:
                    shard, ledger = key, Ledger(lease=lease)
                out += apply_events(ledger, shard, [Event(*fields)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = events.select("shard", *(F.col(c).cast("string" if c in ("action", "owner") else "long") for c in _FIELDS))
    return rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("at"), "event_id").mapInArrow(run, OUT)


def _few(frames: list[pd.DataFrame]) -> list[Event]:
    """Events of a few small frames by (at, event_id), nulls last, as plain values: most shards have some events a portion, and tables for each would take longer than their rules."""
    none = lambda x: x is None or x != x
    rows = (Event(*r) for f in frames for r in zip(*(f[c].tolist() for c in _FIELDS), strict=True))
    events = [Event(*(None if none(x) else x if isinstance(x, str) else int(x) for x in e)) for e in rows]
    return sorted(events, key=lambda e: (e.at is None, e.at or 0, e.event_id is None, e.event_id or 0))


def in_order(frames: Iterable[pd.DataFrame], size: int = RUN) -> Iterator[Event]:
    """Events by (at, event_id). Runs of about `size` rows are sorted and kept in a temporary folder, then merged; one run is in memory at a time. A portion of up to FEW rows needs neither."""
    held: list[pd.DataFrame] = []
    frames = iter(frames)
    for f in frames:
        held.append(f)
        if sum(map(len, held)) > min(FEW, size):
            break
    else:
        yield from _few(held)
        return
    frames = itertools.chain(held, frames)
    held = []
    with tempfile.TemporaryDirectory() as folder:
        files: list[str] = []

        def sorted_run() -> pa.Table:
            f = pd.concat(held).sort_values(["at", "event_id"])
            held.clear()
            return pa.table([pa.array(f[c], t, from_pandas=True) for c, t in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)

        def back(name: str) -> Iterator[Event]:
            with pa.OSFile(name) as source:
                for b in pa.ipc.open_stream(source):
                    yield from map(Event, *(c.to_pylist() for c in b.columns))

        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= size:
                t = sorted_run()
                files.append(f"{folder}/{len(files)}")
                with pa.OSFile(files[-1], "wb") as sink, pa.ipc.new_stream(sink, t.schema) as writer:
                    writer.write_table(t, max_chunksize=max(1, min(1000, size)))
        last = map(Event, *(c.to_pylist() for c in sorted_run().columns)) if held else iter(())
        yield from heapq.merge(*map(back, files), last, key=lambda e: (e.at is None, e.at, e.event_id))


class LeaseProcessor(StatefulProcessor):
    """The same for a stream: state lives with the shard, micro-batches bring its next events."""

    def __init__(self, lease: int = LEASE):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger = Ledger(*(self.state.get() or ()), lease=self.lease)
        for part in _batched(apply_events(ledger, int(key[0]), in_order(rows))):
            yield _frame(part)
        self.state.update(ledger.row())

    def close(self) -> None:
        pass


class ExpiryProcessor(LeaseProcessor):
    """Verdicts and, for each lease that ends, a row of its own as soon as event time has passed its end, not with the shard's next event.

    The row has no event, the action 'expire' and the status 'ended'. It tells, but changes no
    rule: until someone else has claimed the shard, its last owner may still complete it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.told = handle.getValueState("told", "gen long")

    def _ended(self, shard: int, ledger: Ledger, now: int) -> list[tuple]:
        if ledger.status != "claimed" or ledger.expiry >= now or ledger.gen <= (self.told.get() or (0,))[0]:
            return []
        self.told.update((ledger.gen,))
        return [(shard, None, "expire", ledger.owner, True, "ended", ledger.attempts, ledger.gen, ledger.expiry)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger = Ledger(*(self.state.get() or ()), lease=self.lease)
        shard = int(key[0])

        def verdicts() -> Iterator[tuple]:
            for e in in_order(rows):
                if e.at is not None:
                    yield from self._ended(shard, ledger, int(e.at))
                yield from apply_events(ledger, shard, [e])

        for part in _batched(verdicts()):
            yield _frame(part)
        self.state.update(ledger.row())
        if ledger.status == "claimed":
            # a millisecond later: a lease holds through the second that it ends in
            self.handle.registerTimer(ledger.expiry * 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # timers of leases that were completed or claimed again find nothing to tell
        if state := self.state.get():
            passed = -(-expiredTimerInfo.getExpiryTimeInMs() // 1000)
            if rows := self._ended(int(key[0]), Ledger(*state, lease=self.lease), passed):
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip((c.split()[0] for c in OUT.split(", ")), map(list, zip(*rows, strict=True)), strict=True))
    return pd.DataFrame(columns | {"event_id": pd.array(columns["event_id"], "Int64")}, copy=False)


def stream(events: DataFrame, lease: int = LEASE, *, expiries: bool = False) -> DataFrame:
    """A streaming DataFrame of verdicts; the session needs the RocksDB state store. With `expiries` event time comes from `at`, later than 0, and leases that end have rows too."""
    if expiries:
        timed = events.withColumn("at_time", F.timestamp_seconds("at")).withWatermark("at_time", "0 seconds")
        return timed.groupBy("shard").transformWithStateInPandas(ExpiryProcessor(lease), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return events.groupBy("shard").transformWithStateInPandas(LeaseProcessor(lease), outputStructType=OUT, outputMode="Append", timeMode="None")


def follow(events: DataFrame, folder: str, slices: int = 3, lease: int = LEASE, *, expiries: bool = False) -> DataFrame:
    """Verdicts of a stream that finds the events in `slices` portions of time, one after another, with a restart between them.

    What a shard's state is after one portion comes back from the checkpoint for the next.
    """
    spark = events.sparkSession
    provider, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    bounds = events.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    width = ((bounds.b or 0) - (bounds.a or 0)) // slices + 1
    spark.conf.set(key, provider)
    try:
        for i in range(slices):
            low = (bounds.a or 0) + i * width
            events.where((F.col("at") >= low) & (F.col("at") < low + width)).write.parquet(f"{folder}/in/{i}")
            live = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            query = stream(live, lease, expiries=expiries).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/out")


def applyable(events: DataFrame) -> DataFrame:
    """Driver events as lease events: a shard for each user, so that shards grow with the data; purchases complete, the rest claims.

    A completion names the generation that its worker thinks it has: the first or the second.
    """
    complete = F.col("event_type") == "purchase"
    return events.select(
        F.col("user_id").cast("long").alias("shard"), "event_id", F.when(complete, "complete").otherwise("claim").alias("action"),
        F.concat(F.lit("w"), F.pmod("event_id", F.lit(2)).cast("string")).alias("owner"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(complete, F.pmod(F.floor(F.col("event_id") / 2), F.lit(2)) + 1).cast("long").alias("gen"),
    )
