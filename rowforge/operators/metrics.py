"""Metrics with a state: a task adds batches of rows to it, states merge, and the merged state gives the value.

A state is a vector of sums, so a metric's partial states are small rows whatever it has seen.
Several metrics share one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Metric(Protocol):
    """What `evaluate` asks of a metric. Rows come as matrices of predictions and targets."""

    def zero(self) -> np.ndarray:
        """The state that has seen nothing."""

    def add(self, state: np.ndarray, pred: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The state after some more rows."""

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Both states as one, in any order."""

    def compute(self, state: np.ndarray) -> float:
        """The value; NaN of a state that has seen nothing."""


class Mean:
    """A mean: the state is a sum and what it counts. Metrics give `terms`, a sum and a count for some rows."""

    def zero(self) -> np.ndarray:
        return np.zeros(2)

    def add(self, state: np.ndarray, pred: np.ndarray, target: np.ndarray) -> np.ndarray:
        return state + np.array(self.terms(pred, target))

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one + other

    def compute(self, state: np.ndarray) -> float:
        return float(state[0] / state[1]) if state[1] else float("nan")

    def terms(self, pred: np.ndarray, target: np.ndarray) -> tuple[float, int]:
        raise NotImplementedError


class SquaredError(Mean):
    """Of all elements."""

    def terms(self, pred: np.ndarray, target: np.ndarray) -> tuple[float, int]:
        return float(((pred - target) ** 2).sum()), pred.size


@dataclass(frozen=True)
class SwapError(Mean):
    """Squared error after both sides are sorted, within each group of positions or, without groups, within the row; each element has the same weight."""

    groups: tuple[tuple[int, ...], ...] | None = None

    def terms(self, pred: np.ndarray, target: np.ndarray) -> tuple[float, int]:
        total, n = 0.0, 0
        for at in self.groups or (tuple(range(pred.shape[1])),):
            p, t = (np.sort(x[:, list(at)], axis=1) for x in (pred, target))
            total += float(((p - t) ** 2).sum())
            n += p.size
        return total, n


class LogSpectral(Mean):
    """Root mean squared difference of dB spectra, mean of rows."""

    def terms(self, pred: np.ndarray, target: np.ndarray) -> tuple[float, int]:
        p, q = (10 * np.log10(np.maximum(np.abs(np.fft.rfft(x, axis=1, norm="forward")) ** 2, 1e-8)) for x in (pred, target))
        return float(np.sqrt(((p - q) ** 2).mean(axis=1)).sum()), len(pred)


class SpectralL1(Mean):
    """Mean absolute difference of magnitudes, mean of rows."""

    def terms(self, pred: np.ndarray, target: np.ndarray) -> tuple[float, int]:
        gap = np.abs(np.abs(np.fft.rfft(pred, axis=1)) - np.abs(np.fft.rfft(target, axis=1)))
        return float(gap.mean(axis=1).sum()), len(pred)


def _matrices(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (first, first + 1))


def partial_states(pairs: DataFrame, metrics: dict[str, Metric], key: str | None = None) -> DataFrame:
    """(key, metric, state): what each task has added of its rows (key, pred, target). Nothing is shuffled; rows without a vector on both sides aren't added."""
    keyed = [F.col(key).alias("key")] if key else [F.lit(None).cast("int").alias("key")]
    rows = pairs.where("pred is not null and target is not null and size(pred) > 0").select(*keyed, F.col("pred").cast("array<double>"), F.col("target").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}
        kind = pa.null()
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field(0).type
            pred, target = _matrices(b, 1)
            keys = np.array(b.column(0).to_pylist() + [None], dtype=object)[:-1]
            for k in dict.fromkeys(keys):
                at = slice(None) if key is None else np.flatnonzero([x == k or (x is None and k is None) for x in keys])
                for name, metric in metrics.items():
                    states[(k, name)] = metric.add(states.get((k, name), metric.zero()), pred[at], target[at])
        if states:
            yield _rows(states, kind)

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, metric string, state array<double>")


def _rows(states: dict[tuple, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    keys, names = zip(*states, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(names, pa.string()), pa.array(list(states.values()), pa.list_(pa.float64()))], ["key", "metric", "state"])


def merged_states(parts: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """One state for each key and metric. States stream through a task; it holds one of each metric."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, kind = None, pa.null()
        states: dict[tuple, np.ndarray] = {}
        for b in batches:
            kind = b.schema.field(0).type
            for k, name, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if states and k != open_:
                    yield _rows(states, kind)
                    states = {}
                open_ = k
                states[(k, name)] = metrics[name].merge(states.get((k, name), metrics[name].zero()), np.array(state))
        if states:
            yield _rows(states, kind)

    schema = f"key {dict(parts.dtypes)['key']}, metric string, state array<double>"
    return parts.repartition("key").sortWithinPartitions("key", "metric").mapInArrow(run, schema)


def values(states: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """(key, metric, value) of merged states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [metrics[name].compute(np.array(state)) for name, state in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], ["key", "metric", "value"])

    return states.mapInArrow(run, f"key {dict(states.dtypes)['key']}, metric string, value double")


def evaluate(pairs: DataFrame, metrics: dict[str, Metric], key: str | None = None) -> DataFrame:
    """(key, metric, value) for every metric, of all rows or of each key's."""
    return values(merged_states(partial_states(pairs, metrics, key), metrics), metrics)


def over_updates(pairs: DataFrame, metrics: dict[str, Metric], update: str) -> DataFrame:
    """(metric, value, updates): each update's value first, then their mean, so that updates weigh the same however many rows they have."""
    return evaluate(pairs, metrics, update).groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("updates"))
