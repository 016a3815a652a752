"""Moments of every position of wide vectors: states of arrays, folded in tasks and merged pairwise.

A state row is (keys, block, n[], mean[], m2[], low[], high[]): the count, the mean, the sum of
squared deviations from it and the range of BLOCK positions at most. Positions are counted from 0
within block 0, from BLOCK within block 1, and so on, so that a row is bounded however wide the
vectors are, and blocks merge side by side. No component ever becomes a row of its own; only a
finished state does (`by_position`).

A null vector has no positions and a null component isn't counted; positions beyond a vector's end
aren't either. NaN counts, and makes mean and m2 of its position NaN; it's no least value unless
there is no other, and the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a state row.
BLOCK = 8192
#: Bytes of states that a task holds before it passes them on.
HELD = 64 << 20
#: Block of the derived numbers of a row (`derive`), which aren't positions of the vector.
DERIVED = -1
_FIELDS = {"n": "array<bigint>", "mean": "array<double>", "m2": "array<double>", "low": "array<double>", "high": "array<double>"}

Derive = Callable[[np.ndarray], np.ndarray]


class State:
    """Moments of some positions."""

    __slots__ = ("high", "low", "m2", "mean", "n")

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.mean, self.m2, self.low, self.high = n, mean, m2, low, high

    @classmethod
    def of(cls, x: np.ndarray, valid: np.ndarray | None = None) -> State:
        """The state of rows of equal length; around their mean, so that large offsets lose nothing."""
        with np.errstate(invalid="ignore", over="ignore"):
            if valid is None:
                n = np.full(x.shape[1], len(x))
                mean = x.mean(axis=0)
                d = x - mean
                return cls(n, mean, np.einsum("ij,ij->j", d, d), np.fmin.reduce(x, axis=0), x.max(axis=0))
            n = valid.sum(axis=0)
            mean = np.where(valid, x, 0.0).sum(axis=0) / np.maximum(n, 1)
            d = np.where(valid, x - mean, 0.0)
            return cls(n, mean, np.einsum("ij,ij->j", d, d), np.fmin.reduce(np.where(valid, x, np.nan), axis=0), np.where(valid, x, -np.inf).max(axis=0))

    def widened(self, width: int) -> State:
        more = width - len(self.n)
        if more <= 0:
            return self
        pad = lambda x, v: np.concatenate([x, np.full(more, v, dtype=x.dtype)])
        return State(pad(self.n, 0), pad(self.mean, 0.0), pad(self.m2, 0.0), pad(self.low, np.nan), pad(self.high, -np.inf))

    def with_(self, other: State) -> State:
        """Both as one, by the rule of Chan and others."""
        width = max(len(self.n), len(other.n))
        a, b = self.widened(width), other.widened(width)
        n = a.n + b.n
        with np.errstate(invalid="ignore", over="ignore"):
            share = b.n / np.maximum(n, 1)
            d = b.mean - a.mean
            mean = np.where(a.n == 0, b.mean, np.where(b.n == 0, a.mean, a.mean + d * share))
            m2 = a.m2 + b.m2 + np.where((a.n == 0) | (b.n == 0), 0.0, d * d * a.n * share)
            return State(n, mean, m2, np.fmin(a.low, b.low), np.maximum(a.high, b.high))

    def parted(self) -> Iterator[tuple[int, State]]:
        """The state by blocks."""
        for k in range(0, max(1, len(self.n)), BLOCK):
            s = slice(k, k + BLOCK)
            yield k // BLOCK, State(self.n[s], self.mean[s], self.m2[s], self.low[s], self.high[s])


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])


def _state_schema(df: DataFrame, keys: list[str]) -> str:
    return _schema(df, keys, "block int, " + ", ".join(f"{n} {t}" for n, t in _FIELDS.items()))


def _rows(found: list[tuple[tuple, int, State]], key_types: list[pa.DataType], keys: list[str]) -> pa.RecordBatch:
    lists = lambda f, kind: pa.array([getattr(s, f) for _, _, s in found], pa.list_(kind))
    columns = [pa.array([k[i] for k, _, _ in found], t) for i, t in enumerate(key_types)]
    fields = [lists(f, pa.int64() if f == "n" else pa.float64()) for f in _FIELDS]
    return pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b, _ in found], pa.int32()), *fields], [*keys, "block", *_FIELDS])


def _groups(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray | None]]:
    if not n_keys:
        yield (), None
        return
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True)):
        at.setdefault(key, []).append(i)
    for key, rows in at.items():
        yield key, np.array(rows)


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows, and which numbers are there; None if all are."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    there = None if not flat.null_count else ~flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = int(size.max(initial=0))
    if there is None and (size == width).all():
        return x.reshape(len(size), width), None
    valid = np.arange(width) < size[:, None]
    out = np.zeros(valid.shape)
    out[valid] = x if there is None else np.where(there, x, 0.0)
    if there is not None:
        valid[valid] = there
    return out, valid


def states(df: DataFrame, keys: list[str], vector: str = "v", *, derive: Derive | None = None) -> DataFrame:
    """Partial states: what each task has folded of its rows. Only keys and vector are read, and nothing is shuffled.

    `derive` gives numbers of each row from the matrix of rows (0 where a vector has no number);
    their moments are the state of block DERIVED.
    """
    picked = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{vector}`").cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, State] = {}
        types: list[pa.DataType] = []
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (key, whole), s in held.items():
                parts = s.parted() if whole else [(DERIVED, s)]
                for block, part in parts:
                    yield _rows([(key, block, part)], types, keys)

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            for key, at in _groups(b, len(keys)):
                lists = b.column(len(keys))
                lists = lists if at is None else lists.take(pa.array(at))
                lists = lists.filter(lists.is_valid()) if lists.null_count else lists
                if not len(lists):
                    continue
                x, valid = _matrix(lists)
                new = [((key, True), State.of(x, valid))]
                if derive is not None:
                    new.append(((key, False), State.of(derive(x))))
                for k, s in new:
                    size -= 40 * len(held[k].n) if k in held else 0
                    held[k] = held[k].with_(s) if k in held else s
                    size += 40 * len(held[k].n)
                if size > HELD:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    return picked.mapInArrow(run, _state_schema(df, keys))


def merged(parts: DataFrame, keys: list[str], *, fan: int = 64) -> DataFrame:
    """One state for each of `keys` and block, which may be fewer keys than the states have.

    States stream through a task one after another. A key's states are first merged in `fan`
    pieces, so that one key with the states of all tasks is no task's whole work.
    """
    once = parts.select(*(F.col(f"`{k}`") for k in keys), "block", *_FIELDS)
    schema, run = _state_schema(once, keys), _merger(keys)
    by = [*(f"`{k}`" for k in keys), "block"]
    if parts.sparkSession.sparkContext.defaultParallelism > fan:
        piece = F.pmod(F.spark_partition_id(), F.lit(fan)).alias("__piece")
        spread = once.select("*", piece).repartition(*by, "__piece").sortWithinPartitions(*by, "__piece").drop("__piece")
        once = spread.mapInArrow(run, schema)
    return once.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _merger(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, types = None, None, []
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            named = [b.column(i).to_pylist() for i in range(len(keys) + 1)]
            fields = [b.column(len(keys) + 1 + i) for i in range(len(_FIELDS))]
            for i, key in enumerate(zip(*named, strict=True)):
                s = State(*(f[i].values.to_numpy(zero_copy_only=False) for f in fields))
                if key == open_key:
                    state = state.with_(s)
                    continue
                if state is not None:
                    yield _rows([(open_key[:-1], open_key[-1], state)], types, keys)
                open_key, state = key, s
        if state is not None:
            yield _rows([(open_key[:-1], open_key[-1], state)], types, keys)

    return run


def by_position(merged_states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, n, mean, m2, low, high): finished states as rows. Mean and range of a position without numbers are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = b.column(len(keys))[i].as_py()
                if block == DERIVED:
                    continue
                s = State(*(b.column(len(keys) + 1 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(len(_FIELDS))))
                n, none = len(s.n), s.n == 0
                pos = np.arange(block * BLOCK, block * BLOCK + n, dtype=np.int32)
                same = [pa.array([b.column(k)[i].as_py()] * n, b.schema.field(k).type) for k in range(len(keys))]
                numbers = [pa.array(x, pa.float64(), mask=none) for x in (s.mean, s.m2, s.low, s.high)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(pos), pa.array(s.n, pa.int64()), *numbers], [*keys, "pos", "n", "mean", "m2", "low", "high"])

    return merged_states.mapInArrow(run, _schema(merged_states, keys, "pos int, n long, mean double, m2 double, low double, high double"))


def whole(merged_states: DataFrame, keys: list[str], *, bands: int | None = None) -> DataFrame:
    """(keys, n, mean, m2, low, high) of all positions together; with `bands` also `band`, for each run of so many positions.

    A block gives one row for each band that it touches; a band's few rows are then one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = b.column(len(keys))[i].as_py()
                s = State(*(b.column(len(keys) + 1 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(len(_FIELDS))))
                if block == DERIVED or not len(s.n):
                    continue
                band = (block * BLOCK + np.arange(len(s.n))) // (bands or block * BLOCK + len(s.n))
                starts = np.flatnonzero(np.diff(band, prepend=-1))
                n = np.add.reduceat(s.n, starts)
                with np.errstate(invalid="ignore"):
                    mean = np.add.reduceat(s.n * s.mean, starts) / np.maximum(n, 1)
                    off = s.mean - np.repeat(mean, np.diff([*starts, len(s.n)]))
                    m2 = np.add.reduceat(s.m2 + s.n * off * off, starts)
                keep = n > 0
                one = lambda x: pa.array(x[keep])
                same = [pa.array([b.column(k)[i].as_py()] * int(keep.sum()), b.schema.field(k).type) for k in range(len(keys))]
                low, high = np.fmin.reduceat(s.low, starts), np.maximum.reduceat(s.high, starts)
                yield pa.RecordBatch.from_arrays(
                    [*same, one(band[starts].astype(np.int32)), one(n), one(mean), one(m2), one(low), one(high)], [*keys, "band", "n", "mean", "m2", "low", "high"]
                )

    pieces = merged_states.mapInArrow(run, _schema(merged_states, keys, "band int, n long, mean double, m2 double, low double, high double"))
    by = [*keys, "band"] if bands else keys
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    totals = pieces.groupBy(*by).agg(
        F.sum("n").alias("n"), grand.alias("mean"), F.sum("m2").alias("inside"), F.collect_list(F.struct("n", "mean")).alias("ms"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    off = lambda x: x["mean"] - F.col("mean")
    between = F.aggregate("ms", F.lit(0.0), lambda t, x: t + x["n"] * off(x) * off(x))
    return totals.select(*by, "n", "mean", (F.col("inside") + between).alias("m2"), "low", "high")


def derived(merged_states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n[], mean[], m2[], low[], high[]) of the derived numbers."""
    return merged_states.where(F.col("block") == DERIVED).drop("block")
