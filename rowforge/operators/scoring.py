"""Scoring predictions against targets: plain, permutation-invariant and by groups of names."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions import arrays as A
from rowforge.operators.matching import assignment
from rowforge.sources.tables import kept


def per_position_mse(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, mse) of (pred, target) arrays."""
    keys = keys or []
    long = pairs.select(*keys, F.posexplode(A.squared_error("pred", "target")).alias("pos", "e"))
    return long.groupBy(*keys, "pos").agg(F.avg("e").alias("mse"))


def per_parameter_mse(pairs: DataFrame, batch: str, spans: DataFrame) -> DataFrame:
    """(name, mse): positions averaged in each batch, batches with equal weight, then the positions of each name's span [lo, hi).

    `spans` has a row for each parameter, which is not data that grows.
    """
    by_pos = per_position_mse(pairs, [batch]).groupBy("pos").agg(F.avg("mse").alias("mse"))
    named = by_pos.join(F.broadcast(spans), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    return named.groupBy("name").agg(F.avg("mse").alias("mse"))


def best_swap(pairs: DataFrame, batch: str | None = None) -> DataFrame:
    """(pos, mse) after both sides are sorted; with a batch column each element still has the same weight."""
    long = pairs.select(F.posexplode(A.best_swap_error("pred", "target")).alias("pos", "e"))
    return long.groupBy("pos").agg((F.sum("e") / F.count("*")).alias("mse"))


def group_swap(pairs: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(pos, mse) when values may swap only inside a group, a list of positions. Groups are sorted in their row, which isn't shuffled."""
    errors = []
    for at in groups:
        pick = lambda c, at=at: F.array(*(F.get(c, F.lit(i)) for i in at))
        e = A.best_swap_error(pick("pred"), pick("target"))
        errors.append(F.arrays_zip(F.array(*map(F.lit, at)).alias("pos"), e.alias("e")))
    long = pairs.select(F.explode(F.concat(*errors)).alias("x")).select("x.pos", "x.e")
    return long.groupBy("pos").agg((F.sum("e") / F.count("*")).alias("mse"))


#: Blocks of a group, at most, whose orders are all compared for many rows at once (720).
ORDERS = 6


def _orders(cost: np.ndarray) -> np.ndarray:
    """(rows, blocks): the target's block of each block, at the lowest total cost, of (rows, blocks, blocks)."""
    n = cost.shape[1]
    if n > ORDERS:
        return np.array([assignment(c) for c in cost])
    every = np.array(list(itertools.permutations(range(n))))
    return every[cost[:, np.arange(n), every].sum(axis=2).argmin(axis=1)]


def block_swap(pairs: DataFrame, groups: list[list[list[int]]]) -> DataFrame:
    """(pos, mse) when whole blocks of positions may swap inside a group, at the lowest total error of each row.

    A group is a list of blocks of equal width, a block a list of positions. Each batch of
    rows gives a sum for every position; errors stay at the target's positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pred, target = (b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (0, 1))
            total = np.zeros(pred.shape[1])
            for blocks in groups:
                at = np.array(blocks)
                p, t = pred[:, at], target[:, at]  # (rows, blocks, width)
                to = _orders(((p[:, :, None, :] - t[:, None, :, :]) ** 2).sum(axis=3))
                e = (p - np.take_along_axis(t, to[:, :, None], axis=1)) ** 2
                np.add.at(total, at[to], e)
            pos = np.unique(np.concatenate([np.ravel(g) for g in groups]))
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(total[pos]), pa.array([b.num_rows] * len(pos), pa.int64())], ["pos", "e", "n"])

    sums = pairs.select("pred", "target").mapInArrow(run, "pos int, e double, n long")
    return sums.groupBy("pos").agg((F.sum("e") / F.sum("n")).alias("mse"))


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.clip(unit(a) @ unit(b).T, -1, 1)


#: Measures of two blocks of vectors, and which value is the worst.
MEASURES = {"far": (_euclid, "max"), "cosine": (_cosine, "min")}


def worst_pairs(df: DataFrame, group: str, key: str, vector: str = "v", *, block: int = 2048, digits: int = 6) -> DataFrame:
    """(group, <name>, <name>_a, <name>_b) for each of MEASURES: the worst value, rounded, over all pairs in a group, with its pair, ties to the smallest keys.

    All pairs are what is asked for, so the work is quadratic in a group: rows are dealt to
    blocks by a hash, two blocks meet in a task as matrices, and each meeting passes on one row for each measure.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    d = df.select(group, F.col(key).alias("__k"), F.col(vector).alias("__v")).join(sizes, group).withColumn("__b", F.pmod(F.xxhash64("__k"), F.col("__n")).cast("int"))
    # block x of a pair (x, y) is on side 0, block y >= x on side 1
    up = d.select(group, "__k", "__v", F.col("__b").alias("x"), F.explode(F.sequence(F.col("__b"), F.col("__n") - 1)).alias("y"), F.lit(0).alias("side"))
    down = d.where("__b > 0").select(group, "__k", "__v", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)).alias("x"), F.col("__b").alias("y"), F.lit(1).alias("side"))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__k", kind="stable")
        x, y = int(f["x"].iloc[0]), int(f["y"].iloc[0])
        left = f[f["side"] == 0]
        right = left if x == y else f[f["side"] == 1]
        out = []
        if len(left) and len(right):
            a, b = (np.stack(s["__v"].to_numpy()) for s in (left, right))
            ka, kb = left["__k"].to_numpy(), right["__k"].to_numpy()
            for name, (measure, how) in MEASURES.items():
                m = np.round(measure(a, b), digits) * (1 if how == "max" else -1)
                if x == y:
                    m[np.tril_indices(len(m))] = -np.inf
                if not np.isfinite(m.max()):
                    continue
                i, j = np.nonzero(m == m.max())
                lo, hi = np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j])
                first = np.lexsort((hi, lo))[0]
                out.append((f[group].iloc[0], name, float(m.max()), int(lo[first]), int(hi[first])))
        return pd.DataFrame(out, columns=["g", "name", "m", "a", "b"])

    kind = dict(df.dtypes)[group]
    found = up.unionByName(down).groupBy(group, "x", "y").applyInPandas(meet, f"g {kind}, name string, m double, a long, b long")
    best = F.max_by(F.struct("m", "a", "b"), F.struct(F.col("m"), -F.col("a"), -F.col("b")))
    worst = found.groupBy("g", "name").agg(best.alias("w"))
    one = lambda n, c: F.max(F.when(F.col("name") == n, F.col(f"w.{c}")))
    columns = [(one(n, "m") * (1 if how == "max" else -1)).alias(n) for n, (_, how) in MEASURES.items()]
    columns += [one(n, side).alias(f"{n}_{side}") for n in MEASURES for side in ("a", "b")]
    return worst.groupBy(F.col("g").alias(group)).agg(*columns)


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, std) with the sample std, as metric tables have it."""
    found = df.agg(*(F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns))
    return found.select(F.inline(F.array(*columns)))


def bucket_means(df: DataFrame, value: str, at: str, n: int) -> DataFrame:
    """(bucket, mean) of n equal buckets of [0, 1]; an empty one has NaN."""
    bucket = F.least(F.greatest(F.floor(F.col(at) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    means = df.groupBy(bucket.alias("bucket")).agg(F.avg(value).alias("mean"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(means, "bucket", "left").select("bucket", F.coalesce("mean", F.lit(float("nan"))).alias("mean"))


#: Values of a leaf of a digest tree, about, at most.
LEAF = 256


def digest_tree(df: DataFrame, group: str, value: str, *, leaf: int = LEAF, depth: int | None = None) -> DataFrame:
    """(group, prefix, digest): a tree of digests over the distinct values of each group, whatever their order in the table.

    A leaf holds the values whose MD5 starts with its prefix, in order and framed by their
    lengths; a node above has the digests of its sixteen children at most; the root has an empty
    prefix. Depth is such that the largest group has about `leaf` values in a leaf, so no row
    holds more, however large the groups are; runs are compared at the same depth. A null value is none.
    """
    values = df.select(F.col(group).alias("g"), F.col(value).alias("k")).where("k is not null")
    if depth is None:
        n = values.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        depth = next(d for d in range(33) if n <= leaf * 16**d)
    framed = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: F.concat_ws(":", F.length(x), x)), "|")
    level = values.distinct().groupBy("g", F.substring(F.md5("k"), 1, depth).alias("prefix")).agg(F.sha2(framed, 256).alias("digest"))
    tree = level = kept(level)
    for d in range(depth - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda s: s["digest"]), "|")
        level = level.groupBy("g", F.substring("prefix", 1, d).alias("up")).agg(F.sha2(children, 256).alias("digest")).withColumnRenamed("up", "prefix")
        tree = tree.unionByName(level)
    return tree.select(F.col("g").alias(group), "prefix", "digest")


def identity_digest(df: DataFrame, group: str, value: str, *, leaf: int = LEAF) -> DataFrame:
    """(group, identity): the root of each group's digest tree."""
    return digest_tree(df, group, value, leaf=leaf).where("prefix = ''").select(group, F.col("digest").alias("identity"))


def first_differences(one: DataFrame, other: DataFrame, group: str) -> DataFrame:
    """(group, prefix): of two digest trees of equal depth the first leaf that differs in each group; none for equal groups.

    Only children of nodes that differ are looked at, level by level.
    """
    a, b = (t.select(F.col(group).alias("g"), "prefix", F.col("digest").alias(n)) for t, n in ((one, "x"), (other, "y")))
    both = kept(a.join(b, ["g", "prefix"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).withColumn("depth", F.length("prefix")))
    depth = both.agg(F.max("depth")).first()[0] or 0
    open_ = both.where("depth = 0").select("g", "prefix")
    for d in range(1, depth + 1):
        below = both.where(F.col("depth") == d).select("g", "prefix")
        first = open_.select("g", F.col("prefix").alias("up"))
        open_ = below.join(first, (below["g"] == first["g"]) & (F.substring(below["prefix"], 1, d - 1) == first["up"]), "left_semi")
        open_ = open_.groupBy("g").agg(F.min("prefix").alias("prefix"))
    return open_.select(F.col("g").alias(group), "prefix")
