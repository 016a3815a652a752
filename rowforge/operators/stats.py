"""Mergeable statistics of vectors and columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.operators import moments
from rowforge.operators.ranking import positions
from rowforge.sources.tables import kept


def partials(long: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, n, mean, m2): count, mean and sum of squared deviations, computed around the mean, so large offsets lose nothing."""
    return long.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial states of equal keys as one: two passes over the small table of states, the common mean first."""
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    grand = parts.groupBy(*keys).agg(mean.alias("gm"))
    d = F.col("mean") - F.col("gm")
    return (
        parts.join(grand, keys)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.first("gm").alias("mean"), F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"))
    )


def refusals(state: DataFrame) -> DataFrame:
    """The states that have no usable std, with `problem`: 'too few rows' (one or none) or 'no variance'."""
    return state.withColumn("problem", F.when(F.col("n") <= 1, "too few rows").when(F.col("m2") <= 0, "no variance")).where("problem is not null")


def finalise(state: DataFrame, *, mask: bool = False, least: float = 0.0, strict: bool = False) -> DataFrame:
    """Population std of each state; null for fewer than two rows.

    `mask`: 1.0 in place of a std that isn't above `least`. `strict`: without a mask, a state
    without variance or with fewer than two rows is an error when rows are read.
    """
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.col("n")))
    if mask:
        sd = F.when(sd <= least, 1.0).otherwise(sd)
    if strict:
        problem = F.when(sd.isNull(), "too few rows").when(sd <= 0, "no variance")
        sd = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("no std: "), problem)).cast("double")).otherwise(sd)
    return state.withColumn("std", sd)


def channel_states(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, pos, n, mean, m2) of every position of a vector column, without a row for each component."""
    done = moments.merged(moments.states(df, keys, vector), keys)
    return moments.by_position(done, keys).drop("low", "high")


def shard_states(df: DataFrame, shard: str, expected: DataFrame, vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """Array states of each shard, and (shard, problem) of the expected ones that have no vectors."""
    there = df.where(F.col(vector).isNotNull()).select(shard).distinct()
    empty = expected.select(shard).join(there, shard, "left_anti").withColumn("problem", F.lit("empty shard"))
    return moments.merged(moments.states(df, [shard], vector), [shard]), empty


def degenerate(final: DataFrame, pos: str = "pos", shown: int = 20) -> DataFrame:
    """One row: how many positions have no variance, the first `shown` of them, and how many more there are."""
    bad = final.where("std <= 0 or std is null")
    rank = F.row_number().over(Window.orderBy(pos))
    return bad.groupBy().agg(F.count("*").alias("n")).crossJoin(
        bad.withColumn("r", rank).where(F.col("r") <= shown).agg(F.sort_array(F.collect_list(pos)).alias("positions"))
    ).select("n", "positions", F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def standardised(df: DataFrame, final: DataFrame, vector: str = "v") -> DataFrame:
    """Adds `z`, the vector standardised by the statistics (pos, mean, std) of its positions.

    The statistics are one row of two arrays, as long as a vector, that goes to every task; rows stay where they are.
    """
    one = final.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("__s"))
    z = F.zip_with(vector, "__s", lambda x, s: (x - s["mean"]) / s["std"])
    return df.crossJoin(F.broadcast(one)).withColumn("z", z).drop("__s")


def column_profile(df: DataFrame, vector: str = "v", *, keys: list[str] | None = None, dead: float = 1e-6, bands: int | None = None, frames: int | None = None) -> DataFrame:
    """One row for each group of `keys`: spread of channel means and stds, global moments, dead channels, row L2.

    One pass over the rows folds all of it into array states. `bands`: a row for each run of so
    many positions, with `band`. `frames`: a row is a (channels, frames) tensor in C order. Then
    frame_cv is the mean over rows of std / mean of its frames' L2 norms; a row whose mean is
    zero makes it NaN. Without rows there is no profile.
    """
    by = keys or []

    def row_numbers(x: np.ndarray) -> np.ndarray:
        square = x * x
        if bands:
            return np.sqrt(np.add.reduceat(square, np.arange(0, x.shape[1], bands), axis=1)) if x.shape[1] else square
        norm = np.sqrt(square.sum(axis=1))
        if frames is None:
            return norm[:, None]
        energy = np.zeros((len(x), frames))
        for k in range(0, x.shape[1], frames):
            energy[:, : len(square[0, k : k + frames])] += square[:, k : k + frames]
        frame = np.sqrt(energy)
        mean = frame.mean(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.stack([norm, np.where(mean == 0, np.nan, frame.std(axis=1) / mean)], axis=1)

    state = kept(moments.merged(moments.states(df, by, vector, derive=row_numbers), by))
    group = [*by, "band"] if bands else by
    channel = finalise(moments.by_position(state, by).where("n > 0"))
    if bands:
        channel = channel.withColumn("band", (F.col("pos") / bands).cast("int"))
    three = lambda c: [F.min(c).alias(f"{c}_min"), F.percentile(c, 0.5).alias(f"{c}_median"), F.max(c).alias(f"{c}_max")]
    left = channel.groupBy(*group).agg(*three("mean"), *three("std"), F.count_if(F.col("std") < dead).alias("dead"))
    total = moments.whole(state, by, bands=bands).select(*group, F.col("mean").alias("global_mean"), F.sqrt(F.col("m2") / F.col("n")).alias("global_std"), "low", "high")
    at = F.col("band") if bands else F.lit(0)
    of = lambda c, i: F.get(c, i)
    rows = moments.derived(state, by)
    if bands:
        rows = total.select(*group).join(rows, by) if by else total.select("band").crossJoin(F.broadcast(rows))
    rows = rows.select(
        *group, of("n", at).alias("rows"), of("mean", at).alias("l2_mean"), F.sqrt(of("m2", at) / of("n", at)).alias("l2_std"),
        *([of("mean", F.lit(1)).alias("frame_cv")] if frames is not None else []),
    )
    if not group:
        return left.crossJoin(total).crossJoin(rows).where("rows is not null")
    return left.join(total, group).join(rows, group)


#: Rows up to which quantiles are taken from one table of distinct values; beyond it rows are ranked by ranges.
SMALL = 1_000_000


def exact_quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float]:
    """Quantiles with linear interpolation between the two ranks around each, from positions by ranges; nulls don't count."""
    values = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"))
    ranked = positions(values, "x")
    n = values.count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    wanted = sorted({r for p in at for r in (math.floor(p), math.ceil(p))})
    found = {r.i: r.x for r in ranked.where(F.col("i").isin(wanted)).collect()}  # two ranks a quantile
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in at]


def distance_summary(df: DataFrame, x: str) -> DataFrame:
    """Count, mean, population std, min, quartiles and max; exact quantiles with linear interpolation."""
    shares = [0.25, 0.5, 0.75]
    moments = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    if df.limit(SMALL + 1).count() <= SMALL:
        q = F.percentile(x, F.array(*map(F.lit, shares)))
        cuts = [q[i] for i in range(3)]
    else:
        cuts = [F.lit(v).cast("double") for v in exact_quantiles(df, x, shares)]
    found = df.agg(*moments, *(c.alias(n) for n, c in zip(("p25", "median", "p75"), cuts, strict=True)))
    return found.select("n", "mean", "std", "min", "p25", "median", "p75", "max")
