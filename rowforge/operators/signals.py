"""Spectra of signals in Arrow batches; distances and averages as DataFrame operations where they can be."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def framed(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """(rows, frames, window): centered frames, zeros beyond both ends."""
    half = window // 2
    padded = np.pad(x, ((0, 0), (half, half + window)))
    n = 1 + x.shape[1] // hop
    return np.stack([padded[:, i * hop : i * hop + window] for i in range(n)], axis=1)


def spectrum(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """(rows, frames, bins): magnitudes of Hann-windowed frames."""
    return np.abs(np.fft.rfft(framed(x, window, hop) * np.hanning(window + 1)[:-1], axis=2))


def hertz(mel: np.ndarray) -> np.ndarray:
    """Frequencies of mels: linear up to 1,000 Hz (15 mels), then 27 mels for a factor of 6.4."""
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_bands(window: int, bands: int, rate: int) -> np.ndarray:
    """(bands, bins): triangles of unit area between edges that are equally far apart in mels, from 0 to half the rate."""
    top = rate / 2
    last = top * 3 / 200 if top < 1000 else 15 + 27 * np.log(top / 1000) / np.log(6.4)
    edges = hertz(np.linspace(0, last, bands + 2))
    at = np.arange(window // 2 + 1) * rate / window
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid))) * 2 / (high - low)


def score_pairs(pairs: DataFrame, name: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], keys: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """(keys, name): one number for each row of (pred, target), from a kernel over batches of rows."""
    kept = pairs.select(*keys, "pred", "target")
    schema = ", ".join([*(f"{k} {dict(kept.dtypes)[k]}" for k in keys), f"{name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, t = _matrix(b.column(len(keys))), _matrix(b.column(len(keys) + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(kernel(a, t) if len(a) else np.empty(0))], [*keys, name])

    return kept.mapInArrow(run, schema)


def spectral_transport(pairs: DataFrame, window: int, hop: int) -> DataFrame:
    """(vec_id, sot): frames' magnitudes as histograms, first Wasserstein distance over bins, mean over frames."""

    def kernel(a: np.ndarray, t: np.ndarray) -> np.ndarray:
        p, q = (s / np.maximum(s.sum(axis=2, keepdims=True), 1e-6) for s in (spectrum(a, window, hop), spectrum(t, window, hop)))
        return (np.abs(np.cumsum(p - q, axis=2)).sum(axis=2) / p.shape[2]).mean(axis=1)

    return score_pairs(pairs, "sot", kernel).select("vec_id", F.round("sot", 6).alias("sot"))


def scales_at(rate: int, scales: tuple[tuple[float, float, int], ...] = ((10, 5, 32), (25, 10, 64), (100, 50, 128))) -> tuple[tuple[int, int, int], ...]:
    """(window, hop, bands) in whole samples, of milliseconds; what is left of a sample is cut off."""
    return tuple((int(w * rate / 1000), int(h * rate / 1000), bands) for w, h, bands in scales)


def multi_scale(pairs: DataFrame, scales: tuple[tuple[int, int, int], ...] | None = None, *, rate: int = 44_100) -> DataFrame:
    """(vec_id, mss): mean absolute difference of mel band powers in dB below the row's peak, floor 80 dB, averaged over scales (`scales_at` by default)."""
    used = [(w, h, mel_bands(w, bands, rate)) for w, h, bands in scales or scales_at(rate)]

    def decibels(x: np.ndarray, window: int, hop: int, filters: np.ndarray) -> np.ndarray:
        power = spectrum(x, window, hop) ** 2 @ filters.T
        top = power.max(axis=(1, 2), keepdims=True)
        return np.maximum(10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(np.maximum(top, 1e-10)), -80)

    def kernel(a: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.mean([np.abs(decibels(a, *s) - decibels(t, *s)).mean(axis=(1, 2)) for s in used], axis=0)

    return score_pairs(pairs, "mss", kernel).select("vec_id", F.round("mss", 6).alias("mss"))


def frames(vectors: DataFrame, window: int, hop: int, *, floor_db: float = 80.0) -> DataFrame:
    """(vec_id, frame, loudness, centroid): loudness in [0, 1] over the range below the row's peak, centroid in octaves above the lowest bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = spectrum(_matrix(b.column(1)), window, hop)
            rms = np.sqrt((s**2).mean(axis=2))
            db = 20 * np.log10(np.maximum(rms, 1e-10))
            top = db.max(axis=1, keepdims=True)
            loud = np.clip((np.maximum(db, top - floor_db) - (top - floor_db)) / floor_db, 0, 1)
            bins = np.arange(s.shape[2])
            center = (s * bins).sum(axis=2) / np.maximum(s.sum(axis=2), 1e-12)
            n, k = loud.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
                    pa.array(np.round(loud.ravel(), 6)), pa.array(np.round(np.log2(np.maximum(center, 1.0)).ravel(), 6)),
                ],
                ["vec_id", "frame", "loudness", "centroid"],
            )

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, frame int, loudness double, centroid double")
