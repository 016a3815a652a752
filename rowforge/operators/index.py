"""An inverted-file index with residual product quantisation: cells in pieces of bounded size, searched as far as bounds ask."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowforge.operators.matching import TILE, Best
from rowforge.sources.tables import is_complete, kept

#: Rows that cells and codebooks are fitted on: those with the smallest hashes of their ids, so many or PER_CELL for each cell. All rows are indexed.
SAMPLE = 20_000
PER_CELL = 16
MIN_ROWS = 256
#: Cells, at most, so that their centers can go to every task (32 MB of 64 numbers each); with more rows cells have more pieces.
MAX_CELLS = 65_536
#: Rows and bytes of vectors that a piece of a cell holds, at most.
PIECE = 4096
PIECE_BYTES = 4 << 20
#: Queries, and bytes of them, at most, that go to every task, which then searches its own pieces for all of them.
FEW = 131_072
QUERY_BYTES = 64 << 20
#: Of more queries: those that meet a chunk of rows in a task, about, and rows and bytes of a chunk.
ASKED = 65_536
CHUNK = 65_536
CHUNK_BYTES = 64 << 20
METRICS = ("cosine", "l2", "dot")


@dataclass(frozen=True)
class IndexConfig:
    cells: int
    parts: int = 16
    codes: int = 16
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric {self.metric} is none of {', '.join(METRICS)}")

    def matches(self, other: IndexConfig) -> bool:
        """An index is used again only with the same metric, cells and parts."""
        return (self.metric, self.cells, self.parts) == (other.metric, other.cells, other.parts)


@dataclass
class VectorIndex:
    config: IndexConfig
    centers: np.ndarray  # (cells, dim)
    radii: np.ndarray  # (cells,): the farthest row of each cell, -1 without rows
    books: np.ndarray  # (parts, codes, dim / parts), of residuals
    rows: DataFrame  # pieces of cells: cell, piece, n, low, high, ids, codes, errors, x


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centers of one part's values by Lloyd's rounds from a spread start; an empty center stays where it is."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)
        n = np.bincount(at, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def affinity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """How near rows of x are to rows of q: larger is nearer. Cosines are of unit vectors, which both must be."""
    dot = q @ x.T
    return dot if metric != "l2" else 2 * dot - (q**2).sum(axis=1)[:, None] - (x**2).sum(axis=1)[None, :]


def _cells(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, some rows at a time: memory doesn't grow with the number of cells."""
    out = np.empty(len(x), dtype=np.int64)
    for at in _tiles(len(x), len(centers)):
        out[at] = _nearness(x[at], centers, "l2").argmax(axis=1)
    return out


def build(vectors: DataFrame, config: IndexConfig | None = None, *, sample: int = SAMPLE) -> VectorIndex | None:
    """Index all rows of (vec_id, v); None for fewer than MIN_ROWS. Cells default to the root of the row count, MAX_CELLS at most.

    Cells are clusters of Spark's k-means. A row's code stands for its residual, what is left of
    it without its cell's center; the parts' codebooks are fitted side by side in tasks, each on a
    few numbers of each sampled row. The driver holds cells and codebooks. A cell's rows are kept
    in pieces, which have the least and the largest distance of their rows to the center, and how
    far each row is from what its code stands for.
    """
    n = vectors.count()
    if n < MIN_ROWS:
        return None
    config = config or IndexConfig(cells=min(MAX_CELLS, max(1, round(n**0.5))))
    dim = vectors.select(F.size("v")).first()[0]
    if dim % config.parts:
        raise ValueError(f"{config.parts} parts don't divide {dim} dimensions")
    width, metric = dim // config.parts, config.metric
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, PER_CELL * config.cells)).select("vec_id", "v")
    if metric == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        some = some.withColumn("v", F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-300))))
    some = kept(some)
    fitted = KMeans(k=config.cells, seed=1, maxIter=8, featuresCol="f").fit(some.select(array_to_vector("v").alias("f")))
    centers = np.array(fitted.clusterCenters())
    context = vectors.sparkSession.sparkContext
    middle = context.broadcast(centers)

    def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not f.empty:
                u = np.stack(f["v"].to_numpy())
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": list(u - middle.value[_cells(u, middle.value)])})

    def book(f: pd.DataFrame) -> pd.DataFrame:
        p = int(f["part"].iloc[0])
        c = lloyd(np.stack(f.sort_values("vec_id")["x"].to_numpy()), config.codes, 2 + p)
        return pd.DataFrame({"part": p, "code": np.arange(len(c)), "x": list(c)})

    left = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).mapInPandas(residuals, "vec_id long, v array<double>")
    parts = left.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(config.parts - 1)), lambda p: F.slice("v", p * width + 1, width))).alias("part", "x"))
    found = parts.groupBy("part").applyInPandas(book, "part int, code int, x array<double>").orderBy("part", "code").toPandas()
    books = np.stack([np.stack(g["x"].to_numpy()) for _, g in found.groupby("part")])
    shared = context.broadcast((centers, books))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            u = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            u = unit(u) if metric == "cosine" else u
            cell = _cells(u, centers)
            rest = u - centers[cell]
            code = np.stack([affinity(rest[:, p * width : (p + 1) * width], c, "l2").argmax(axis=1) for p, c in enumerate(books)], axis=1)
            told = np.concatenate([c[code[:, p]] for p, c in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cell, pa.int32()), pa.array(np.linalg.norm(rest, axis=1)), pa.array(np.linalg.norm(rest - told, axis=1)), _binary(code.astype(np.uint16)), _binary(u)],
                ["vec_id", "cell", "gap", "error", "code", "x"],
            )

    placed = kept(vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(place, "vec_id long, cell int, gap double, error double, code binary, x binary"))
    size = max(1, min(PIECE, PIECE_BYTES // (8 * dim)))
    heaps = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("heaps"))  # a row for each cell
    dealt = placed.join(F.broadcast(heaps), "cell").withColumn("heap", F.pmod(F.xxhash64("vec_id"), "heaps").cast("int"))
    columns = ["cell", "heap", "gap", "vec_id", "error", "code", "x"]
    rows = kept(dealt.select(columns).repartition("cell", "heap").sortWithinPartitions("cell", "heap", "gap", "vec_id").mapInArrow(_packer(size), _PIECES))
    radii = np.full(len(centers), -1.0)
    for r in rows.groupBy("cell").agg(F.max("high").alias("r")).collect():
        radii[r.cell] = r.r
    return VectorIndex(config, centers, radii, books, rows)


_PIECES = "cell int, piece long, n int, low double, high double, ids array<bigint>, codes binary, errors array<double>, x binary"


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _packer(size: int):
    """Rows sorted by cell, heap and distance to pieces of at most `size` rows."""

    def piece(held: list[dict], at: tuple[int, int], number: int) -> pa.RecordBatch:
        gaps, ids, errors = ([h[c] for h in held] for c in ("gap", "vec_id", "error"))
        row = {"cell": at[0], "piece": at[1] << 24 | number, "n": len(held), "low": min(gaps), "high": max(gaps), "ids": ids, "codes": b"".join(h["code"] for h in held), "errors": errors, "x": b"".join(h["x"] for h in held)}
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, number = [], None, 0
        for b in batches:
            for r in b.to_pylist():
                key = (r["cell"], r["heap"])
                if held and (key != at or len(held) == size):
                    yield piece(held, at, number)
                    held, number = [], number + 1
                number, at = (number if key == at else 0), key
                held.append(r)
        if held:
            yield piece(held, at, number)

    return run


def save(index: VectorIndex, folder: str) -> None:
    """Tables of pieces, cells and codebooks, then the configuration, which makes the index whole."""
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").parquet(f"{folder}/rows")
    cells = [(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(index.centers, index.radii, strict=True))]
    spark.createDataFrame(cells, "i int, x array<double>, radius double").write.mode("overwrite").parquet(f"{folder}/centers")
    books = [(i, r.tolist()) for i, r in enumerate(index.books.reshape(-1, index.books.shape[2]))]
    spark.createDataFrame(books, "i int, x array<double>").write.mode("overwrite").parquet(f"{folder}/books")
    spark.createDataFrame([tuple(asdict(index.config).values())], "cells int, parts int, codes int, metric string").write.mode("overwrite").parquet(f"{folder}/config")


def load(spark: SparkSession, folder: str, config: IndexConfig) -> VectorIndex | None:
    """The stored index; None where none is whole or it has another metric, cells or parts."""
    if not is_complete(spark, f"{folder}/config"):
        return None
    stored = IndexConfig(**spark.read.parquet(f"{folder}/config").first().asDict())
    if not stored.matches(config):
        return None
    cells, books = (spark.read.parquet(f"{folder}/{n}").orderBy("i").toPandas() for n in ("centers", "books"))
    books = np.stack(books["x"].to_numpy())
    return VectorIndex(stored, np.stack(cells["x"].to_numpy()), cells["radius"].to_numpy(), books.reshape(stored.parts, -1, books.shape[1]), spark.read.schema(_PIECES).parquet(f"{folder}/rows"))


def _most(metric: str, q: np.ndarray, dot: np.ndarray, center2: np.ndarray, low: np.ndarray | float, high: np.ndarray) -> np.ndarray:
    """The best score that a row between `low` and `high` from a center may have. dot: queries x centers."""
    own = (q**2).sum(axis=1)[:, None]
    if metric == "dot":
        return dot + np.sqrt(own) * high
    gap = np.sqrt(np.maximum(0.0, own + center2 - 2 * dot))
    least = np.maximum(0.0, np.maximum(gap - high, low - gap))
    return -(least**2) if metric == "l2" else 1 - least**2 / 2


_SLACK = 1e-9


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int | None = 8, refine: int | None = 30) -> DataFrame:
    """(query_id, rank, vec_id, score) of (query_id, q), from the `probes` nearest cells of each query.

    A task goes through its pieces once with all queries that it has, and holds the best k rows
    of each query: cells beyond the probes, and pieces whose bounds hold nothing better than what
    was found, end there. Of a piece the best refine * k rows by code count. Up to FEW queries, of
    QUERY_BYTES together, go to every task and the pieces stay where they are; of more queries
    each block meets each chunk of pieces in a task. Candidates, k for each query and task, are
    all that is passed on. score is the metric's: a cosine, a dot product or a negative squared
    distance. Where balls can't be told apart all `probes` cells are searched. With probes None
    any cell may be searched, and with refine None codes leave out no row: the result is then
    exact, but for ties.
    """
    keep, probes = refine and refine * k, probes or len(index.centers)
    n, values = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    asked = _asked(index, queries, probes)
    found = _in_place(index, asked, k, keep) if n <= FEW and 8 * values <= QUERY_BYTES else _by_blocks(index, asked, n, k, keep)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearness(q: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ centers.T
    return dot if metric == "dot" else 2 * dot - (centers**2).sum(axis=1)


def _asked(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, cut): queries as the metric takes them, and how near the last of its `probes` cells with rows is to each."""
    metric = index.config.metric
    filled = index.centers[index.radii >= 0]
    shared = queries.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            q = unit(q) if metric == "cosine" else q
            cut = np.full(len(q), -np.inf)
            if probes < len(shared.value):
                for at in _tiles(len(q), len(shared.value)):
                    cut[at] = -np.partition(-_nearness(q[at], shared.value, metric), probes - 1, axis=1)[:, probes - 1]
            ends = pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(q.ravel())), pa.array(cut)], ["query_id", "q", "cut"])

    return queries.select("query_id", F.col("q").cast("array<double>").alias("q")).mapInArrow(run, "query_id long, q array<double>, cut double")


def _tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows, so that one with all columns has about TILE numbers."""
    step = max(1, TILE // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


class _Searched:
    """The best k rows of each of a task's queries, piece by piece."""

    def __init__(self, index: tuple[np.ndarray, np.ndarray, str], q: np.ndarray, cut: np.ndarray, k: int, keep: int | None):
        self.centers, self.books, self.metric = index
        self.q, self.cut, self.keep = q, cut, keep
        self.best = Best(len(q), k)

    def add(self, row: dict) -> None:
        """A piece: cell, low, high, ids, codes, x as Arrow scalars."""
        center = self.centers[row["cell"].as_py()][None]
        near = _nearness(self.q, center, self.metric)[:, 0]
        mine = np.flatnonzero(near >= self.cut - _SLACK)
        most = _most(self.metric, self.q[mine], self.q[mine] @ center.T, (center**2).sum(axis=1), row["low"].as_py(), row["high"].as_py())[:, 0]
        mine = mine[most >= self.best.floor(mine) - _SLACK]
        if not len(mine):
            return
        ids = row["ids"].values.to_numpy()
        x = np.frombuffer(row["x"].as_py()).reshape(len(ids), -1)
        told = None
        if self.keep and self.keep < len(ids):
            code = np.frombuffer(row["codes"].as_py(), dtype=np.uint16).reshape(len(ids), -1)
            told = center + np.concatenate([c[code[:, p]] for p, c in enumerate(self.books)], axis=1)
        for at in _tiles(len(mine), len(ids)):
            a = self.q[mine[at]]
            self.best.add(mine[at], affinity(a, x, self.metric), ids, None if told is None else self._ahead(a, told))

    def _ahead(self, a: np.ndarray, told: np.ndarray):
        """Of some (query, row): which rows codes put among the query's first `keep`."""

        def ahead(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            some, at = np.unique(i, return_inverse=True)
            about = affinity(a[some], told, self.metric)
            return about[at, j] >= -np.partition(-about, self.keep - 1, axis=1)[at, self.keep - 1]

        return ahead

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        i, ids, score = self.best.rows()
        return pa.RecordBatch.from_arrays([pa.array(query_ids[i], pa.int64()), pa.array(ids, pa.int64()), pa.array(score)], ["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"
_SEARCHED = ["cell", "low", "high", "ids", "codes", "x"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _in_place(index: VectorIndex, asked: DataFrame, k: int, keep: int | None) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task, with all queries in each."""
    t = asked.toArrow()
    if not t.num_rows:
        return asked.sparkSession.createDataFrame([], _FOUND)
    shared = asked.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), _matrix(t["q"]), t["cut"].to_numpy(), (index.centers, index.books, index.config.metric)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, cut, parts = shared.value
        searched = _Searched(parts, q, cut, k, keep)
        for b in batches:
            for r in range(b.num_rows):
                searched.add({c: b.column(i)[r] for i, c in enumerate(b.schema.names)})
        yield searched.batch(query_ids)

    return index.rows.select(_SEARCHED).mapInArrow(run, _FOUND)


def _by_blocks(index: VectorIndex, asked: DataFrame, n: int, k: int, keep: int | None) -> DataFrame:
    """The same for any number of queries: blocks of about ASKED queries meet chunks of about CHUNK rows."""
    dim = index.centers.shape[1]
    parts = max(1, -(-n // max(1, min(ASKED, QUERY_BYTES // (8 * dim)))))
    rows = index.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chunks = max(1, -(-rows // max(1, min(CHUNK, CHUNK_BYTES // (8 * dim)))))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), every(chunks).alias("chunk"))
    right = index.rows.select(*_SEARCHED, F.pmod(F.xxhash64("cell", "piece"), F.lit(chunks)).cast("int").alias("chunk"), every(parts).alias("part"))
    shared = asked.sparkSession.sparkContext.broadcast((index.centers, index.books, index.config.metric))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        searched = _Searched(shared.value, _matrix(a["q"]), a["cut"].to_numpy(), k, keep)
        for r in range(b.num_rows if a.num_rows else 0):
            searched.add({c: b[c][r] for c in _SEARCHED})
        return pa.Table.from_batches([searched.batch(a["query_id"].to_numpy())])

    return left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInArrow(meet, _FOUND)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours (query_id, vec_id) that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("pairs"))
