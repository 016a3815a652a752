"""What the operators of this subpackage share: the shared folder, cut lineage, components, word shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Unset, it's a temporary one on a local master and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _local[app]
    return folder.rstrip("/")


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: later jobs neither repeat this work nor lose it with an executor.

    What results still read from can't be deleted here; the folder is cleared by whoever owns it, as with checkpoints.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _settled(e: DataFrame) -> bool:
    """Whether links (hi, lo) are stars: no hi has two lo, and no lo is a hi too."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Alternates the large-star and small-star steps until all links are stars around their
    smallest node: a logarithmic number of rounds, each of grouping by node with partial
    aggregation. Least neighbours are written before they are joined, so that adaptive
    execution may split the rows of a hub. Only the last round's table stays. Self links and
    links with a null end are ignored; repeated links count once.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = materialize(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), f"{folder}/0")
    turn = 0
    while not _settled(e):
        turn += 1
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{folder}/least-{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, f"{folder}/large-{turn}")
        down = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{folder}/down-{turn}")
        small = (
            large.join(down, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(down.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        e = materialize(small, f"{folder}/{turn}")
        for old in (f"{turn - 1}", f"least-{turn}", f"large-{turn}", f"down-{turn}"):
            delete(spark, f"{folder}/{old}")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


#: Keys, at most, whose rows are joined in place because each has its share of all rows or more.
HEAVY = 2048


def joined_by_count(df: DataFrame, counted: DataFrame, key: str, n: str = "n", *, prune: bool = True) -> DataFrame:
    """df.join(counted, key) without a task for a hot key. `n` is how many rows of df have the key, so no more than HEAVY keys can have 1 / HEAVY of them.

    These are broadcast; of the others only rows that an id filter can't rule out are shuffled
    (all of them without `prune`, for when every row has its match). Both inputs are read more than once.
    """
    counted = materialize(counted)
    least = (counted.agg(F.sum(n)).first()[0] or 0) / HEAVY
    hot = counted.where(F.col(n) >= least)
    rest = (filtered(df, key, id_filter(counted, key), inside=True) if prune else df).join(F.broadcast(hot.select(key)), key, "left_anti")
    return df.join(F.broadcast(hot), key).unionByName(rest.join(counted.where(F.col(n) < least).hint("merge"), key))


#: Bits of an id filter: 262,144 rows of a number and a mask at most, 4 MB, however many ids it stands for.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """(__word, __mask): a bitmap of hashed ids, small enough to broadcast by construction. Null ids aren't in it."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = ids.where(F.col(column).isNotNull()).select((bit / 64).cast("int").alias("__word"), F.expr("1L").alias("__one"), (bit % 64).cast("int").alias("__at"))
    return materialize(words.select("__word", F.expr("shiftleft(__one, __at)").alias("m")).groupBy("__word").agg(F.bit_or("m").alias("__mask")))


def filtered(df: DataFrame, column: str, words: DataFrame, *, inside: bool) -> DataFrame:
    """The rows that may be in an id filter, or those that surely aren't, decided in place without a shuffle.

    The more ids it stands for the more rows pass that needn't; what follows must be exact.
    """
    word, mask = (free_name(n, df.columns) for n in ("__word", "__mask"))
    bit = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(FILTER_BITS))
    held = words.select(F.col("__word").alias(word), F.col("__mask").alias(mask))
    known = df.withColumn(word, (bit / 64).cast("int")).join(F.broadcast(held), word, "left")
    hit = F.coalesce(F.getbit(F.col(mask), (bit % 64).cast("int")) == 1, F.lit(False)) & F.col(f"`{column}`").isNotNull()
    return known.where(hit if inside else ~hit).select(*(F.col(f"`{c}`") for c in df.columns))


def free_name(name: str, columns: list[str]) -> str:
    """A name for a helper column that no input column has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose id isn't in `gone` (one column of that name). Only rows that the id filter can't clear are shuffled."""
    gone = materialize(gone.select(F.col(f"`{column}`").cast(dict(df.dtypes)[column]).alias(column)).distinct())
    words = id_filter(gone, column)
    doubtful = filtered(df, column, words, inside=True).join(gone.hint("merge"), column, "left_anti")
    return filtered(df, column, words, inside=False).unionByName(doubtful.select(*(f"`{c}`" for c in df.columns)))


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal key, from batches that are sorted by it; only the open run is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.table({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
        if not t.num_rows:
            continue
        keys = np.stack([t.column(k).to_numpy() for k in key], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), t.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and not (keys[s] == last).all():
                yield pa.concat_tables(held)
                held = []
            last = keys[s]
            held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


# ---------------------------------------------------------------- word shingles

_WINDOW = 1 << 20  # bytes hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, x in (("up", _BASE), ("down", inverse)):
            f = np.full(n, x, dtype=np.uint64)
            f[0] = 1
            _powers[name] = np.cumprod(f, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are runs of bytes other than space and 0x09 to 0x0D."""
    parts = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _WINDOW)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        x = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        solid = np.zeros(len(x) + 2, dtype=np.int8)
        solid[1:-1] = ~_SPACE[x]
        step = np.diff(solid)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _power(max(len(x) + 1, _WINDOW + 1))
        total = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[x] * up[: len(x)], out=total[1:])
        parts.append(mix64((total[stop] - total[start]) * down[start]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the n-word shingles of hashed words; fewer words make one shingle, none make none."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i])
    return np.unique(h.view(np.int64))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The shingles of a text (`shingles_of`); A-Z count as a-z, null as empty."""
    return shingles_of(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), n)
