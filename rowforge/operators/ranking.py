"""Winners, batches, splits and ranges."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earliest(df: DataFrame, key: str, order: list[str], preferred: Column | None = None) -> DataFrame:
    """One row of each key: a preferred one if there is such, else the first by `order`, which must be total. Aggregated in each task before the shuffle."""
    rank = F.struct(*([F.when(preferred, 0).otherwise(1).alias("__p")] if preferred is not None else []), *order)
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("__r")).select("__r.*")


def winners(candidates: DataFrame, key: str, name: str, order: list[str], healthy: Column, recorded: DataFrame | None = None) -> DataFrame:
    """(key, winner, unhealthy, problem) of every key: the recorded winner if it's healthy, else the first healthy candidate by `order`.

    A key without any has no winner and `problem` says so; `unhealthy` counts the candidates that were skipped.
    """
    rows, first = candidates.withColumn("__h", healthy), F.lit(1)
    if recorded is not None:
        rows = rows.join(recorded.select(key, F.col(name).alias(name), F.lit(True).alias("__k")), [key, name], "left")
        first = F.when(F.col("__k"), 0).otherwise(1)
    best = F.min_by(F.when(F.col("__h"), F.col(name)), F.when(F.col("__h"), F.struct(first, *order)))
    return rows.groupBy(key).agg(best.alias("winner"), F.count_if(~F.col("__h")).alias("unhealthy")).withColumn(
        "problem", F.when(F.col("winner").isNull(), "no healthy candidate")
    )


#: Ranges, at most, that positions are counted by; their bounds are all that the driver sees.
RANGES = 10_000
#: Parts that rows of one common value are numbered in.
TIES = 64


def positions(df: DataFrame, order: str, name: str = "i", per: int = 100_000) -> DataFrame:
    """A gapless position from 0 by `order`, a number, without one task for all rows. Equal values follow one another by a hash of the row.

    Approximate quantiles cut the rows, however their values are spread, into ranges of about
    `per` rows. Rows are counted by range; a running sum over these counts gives each range
    its start, and rows are numbered within their range. A range of a single value, as often
    as it may be, is numbered in TIES parts by the rows' hashes. Null and NaN come last.
    """
    rows = df.count()
    n = min(RANGES, max(1, -(-rows // per)))
    value = F.col(order).cast("double")
    cuts = []
    if n > 1:
        found = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 100 * n)).first()[0] or []
        cuts = sorted({c for c in found if math.isfinite(c)})
    ranged = df.withColumn("__v", value).withColumn("__h", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")], inputCol="__v", outputCol="__b", handleInvalid="keep")
    ranged = cut.transform(ranged)
    single = ranged.groupBy("__b").agg((F.min("__v") == F.max("__v")).alias("__one"), F.count("*").alias("__m"))
    single = single.select("__b", (F.col("__one") & (F.col("__m") > per)).alias("__one"))
    part = F.when(F.col("__one"), F.floor(F.col("__h") / ((1 << 40) // TIES))).otherwise(0).cast("int")
    ranged = ranged.join(F.broadcast(single), "__b").withColumn("__t", part)  # at most RANGES + 2 rows
    counts = ranged.groupBy("__b", "__t").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b", "__t").rowsBetween(Window.unboundedPreceding, -1))  # over ranges, not rows
    starts = counts.select("__b", "__t", F.coalesce(before, F.lit(0)).alias("__s"))
    within = F.row_number().over(Window.partitionBy("__b", "__t").orderBy(order, "__h"))
    numbered = ranged.join(F.broadcast(starts), ["__b", "__t"]).withColumn(name, (F.col("__s") + within - 1).cast("long"))
    return numbered.select(*df.columns, name)


def balanced(position: Column, total: Column, workers: int) -> Column:
    """The worker of a position when `total` items are dealt in contiguous ranges, the first ones getting the extra items."""
    size, extra = F.floor(total / workers), F.pmod(total, F.lit(workers))
    long = extra * (size + 1)
    return F.when(position < long, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - long) / F.greatest(size, F.lit(1)))).cast("int")


def batches(df: DataFrame, order: str, size: int, *, drop_last: bool = True) -> DataFrame:
    """Adds `batch` by position; without the rows of a short last batch unless it is kept."""
    placed = positions(df, order).withColumn("batch", F.floor(F.col("i") / size).cast("long"))
    if not drop_last:
        return placed
    n = placed.agg(F.floor(F.count("*") / size).alias("__full"))
    return placed.crossJoin(F.broadcast(n)).where("batch < __full").drop("__full")


def filled_batches(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, i, order) with exactly `size` rows a key: its first ones, then its first one again."""
    w = Window.partitionBy(key).orderBy(order)
    own = df.select(key, order, (F.row_number().over(w) - 1).alias("i")).where(F.col("i") < size)
    short = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias(order)).where(F.col("n") < size)
    more = short.select(key, F.explode(F.sequence(F.col("n").cast("int"), F.lit(size - 1))).alias("i"), order)
    return own.unionByName(more).select(key, F.col("i").cast("int").alias("i"), order)


def split_ranges(splits: DataFrame, size: str = "shards") -> DataFrame:
    """Adds the half-open range [lo, hi) of shard ids to (pos, split, shards), in the order of pos. One row a split."""
    w = Window.orderBy("pos")
    hi = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return splits.withColumn("hi", hi.cast("long")).withColumn("lo", (F.col("hi") - F.col(size)).cast("long"))


def split_problems(splits: DataFrame, rows: str, rows_per_shard: int, seed: str = "split_seed") -> DataFrame:
    """(split, problem): sizes that aren't a multiple of the rows of a shard, seeds that two splits share, and (split null) no split with rows."""
    size = splits.where(F.col(rows) % rows_per_shard != 0).select("split", F.lit("size is no multiple").alias("problem"))
    shared = splits.where(F.col(seed).isNotNull()).groupBy(seed).agg(F.collect_list("split").alias("s")).where(F.size("s") > 1)
    empty = splits.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("split"), F.lit("all are empty").alias("problem"))
    return size.unionByName(shared.select(F.explode("s").alias("split"), F.lit("seed is not its own").alias("problem"))).unionByName(empty)


def shard_table(splits: DataFrame, rows_per_shard: int, base_seed: int) -> DataFrame:
    """(shard, filename, split, seed, offset) of (pos, split, shards, split_seed). Splits with problems (`split_problems`) are an error.

    With a split seed a shard has it and the offset of its rows in the split; without one the
    base seed plus its number and offset 0.
    """
    bad = split_problems(splits.withColumn("__rows", F.col("shards") * rows_per_shard), "__rows", rows_per_shard).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.split or 'splits'}: {r.problem}" for r in bad))
    s = split_ranges(splits)
    rows = s.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    given = F.col("split_seed").isNotNull()
    return rows.select(
        "shard", F.format_string("shard-%06d", "shard").alias("filename"), "split",
        F.when(given, F.col("split_seed")).otherwise(F.lit(base_seed) + F.col("shard")).cast("long").alias("seed"),
        F.when(given, (F.col("shard") - F.col("lo")) * rows_per_shard).otherwise(0).cast("long").alias("offset"),
    )


def first_accepted(attempts: DataFrame, key: str, attempt: str, reason: str, reasons: list[str], budget: int | None = None) -> DataFrame:
    """(key, accepted, rejected_<reason>..., problem): the lowest attempt without a reason against it, and the reasons of those before.

    With a `budget` only so many attempts of a key, the lowest, count; a key none of whose
    attempts passed has no accepted one and `problem` says so.
    """
    known = attempts
    if budget is not None:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(attempt))
        known = known.withColumn("__k", nth).where(F.col("__k") <= budget)
    best = F.min(F.when(F.col(reason).isNull(), F.col(attempt)))
    known = known.withColumn("__a", best.over(Window.partitionBy(key)))
    before = F.col("__a").isNull() | (F.col(attempt) < F.col("__a"))
    counted = known.groupBy(key).agg(best.alias("accepted"), *(F.count_if(before & (F.col(reason) == r)).alias(f"rejected_{r}") for r in reasons))
    return counted.withColumn("problem", F.when(F.col("accepted").isNull(), "budget used up" if budget is not None else "none accepted"))
