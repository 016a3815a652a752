"""Mixing sources to target weights by Poisson replication, then a global shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import free_name, joined_by_count, materialize

#: Sources whose rates are broadcast; more of them are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Largest rate that one inversion draws: exp(-rate) underflows above 745 and loses digits from 708 on.
LARGEST_RATE = 700.0


def uniform(key: Column, seed: int, purpose: str) -> Column:
    """A number in [0, 1) from 52 bits of MD5; the same row, seed and purpose give the same number everywhere."""
    digest = F.md5(F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_count(u: Column, rate: Column, most: Column) -> Column:
    """The smallest k with u below the Poisson distribution function at k; `most` ends the search far beyond any u."""
    start = F.struct(
        F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.when(u >= F.exp(-rate), F.lit(1)).otherwise(F.lit(0)).alias("k")
    )

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        cdf = s["cdf"] + p
        return F.struct(p.alias("p"), cdf.alias("cdf"), (s["k"] + F.when(u >= cdf, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["k"]


def _most(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")


def poisson_copies(key: Column, seed: int, rate: Column) -> Column:
    """A Poisson draw for each key: one inversion up to LARGEST_RATE, beyond it the sum of independent draws of equal, smaller rates.

    The parts' numbers are hashed from (seed, part, key). The work grows with the rate, as the copies do.
    """
    parts = F.ceil(rate / LARGEST_RATE).cast("int")
    share = rate / parts

    def add(n: Column, part: Column) -> Column:
        return n + poisson_count(uniform(F.concat_ws(":", part.cast("string"), key.cast("string")), seed, "copies-part"), share, _most(share))

    single = poisson_count(uniform(key, seed, "copies"), rate, _most(rate))
    return F.when(rate > LARGEST_RATE, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), add)).otherwise(single)


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: float | None, source_col: str = "source") -> DataFrame:
    """(source, n, rate): mean copies of each document of a source.

    `weights`: relative target of each source, in documents; None means the same for all; a
    source that is not named gets 0. `total`: documents wanted; None means as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"name {dict(docs.dtypes)[source_col]}, w double")
        weighed = counts.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left").select(
            "source", "n", F.coalesce("w", F.lit(0.0)).alias("w")
        )
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    return weighed.crossJoin(F.broadcast(sums)).select(
        "source", "n", F.coalesce(F.try_divide(F.col("w") * wanted, F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    total: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    extras: bool = True,
) -> DataFrame:
    """Each row as often as a Poisson draw with its source's mean rate says, in a global random order.

    The draw inverts the distribution function at a number hashed from (seed, id), or adds up
    such draws where the rate is above LARGEST_RATE, so a rerun or a lost executor gives the
    same copies. A null source is a source of its own; a null or
    repeated id draws once per row, alike for equal ids. With `extras`: columns `replica` (from
    0) and `n_copies`, replacing input columns of these names. Rows go to partitions and are
    ordered within them by a hash of (seed, id, replica). A source without weight, or weights
    that are all 0, give a rate of 0 and no rows; an empty table gives an empty result. Texts
    aren't looked at. Input columns may have any other names.

    The rates have a row per source. They are broadcast only after a count shows at most
    BROADCAST_SOURCES of them; of more sources the common ones are broadcast and the rest joined
    by a shuffle, so no task has all rows of a hot source.
    """
    table = materialize(rates(docs, weights, total, source_col))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    s, m, rate, n, r, o = (free_name(c, docs.columns) for c in ("__s", "__m", "__rate", "__n", "__r", "__o"))
    key = F.col(f"`{id_col}`")
    table = table.select(named("source").alias(s), F.col("n").alias(m), F.col("rate").alias(rate))
    base = (docs.drop("replica", "n_copies") if extras else docs).withColumn(s, named(f"`{source_col}`"))
    joined = base.join(F.broadcast(table), s) if few else joined_by_count(base, table, s, m, prune=False)
    drawn = joined.withColumn(n, poisson_copies(F.coalesce(key.cast("string"), F.lit("null")), seed, F.col(rate)))
    copies = drawn.where(F.col(n) > 0).withColumn(r, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    mixed = copies.withColumn(o, F.xxhash64(F.lit(seed), key, F.col(r))).repartition(F.col(o))
    mixed = mixed.sortWithinPartitions(o)
    if extras:
        mixed = mixed.withColumns({"replica": F.col(r).cast("long"), "n_copies": F.col(n).cast("long")})
    return mixed.drop(s, m, rate, n, r, o)


def expected_copies(rate: float, u: float) -> int:
    """The same inversion for one number and a rate of at most LARGEST_RATE, for tests."""
    if rate > LARGEST_RATE:
        raise ValueError(f"rate {rate} is more than one inversion draws")
    p = cdf = math.exp(-rate)
    k = 0
    while u >= cdf and k < rate + 12 * rate**0.5 + 40:
        k += 1
        p = p * rate / k
        cdf += p
    return k
