"""Joins: identities across sources, ranges, nearest neighbours, assignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import arrays as A
from rowforge.functions.scalars import normal_label
from rowforge.operators.ranking import positions


def resolve_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` with the columns of its only match, and `problem`: 'missing', 'ambiguous' or null."""
    counted = right.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in right.columns if c != key))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous")
    return left.join(counted, key, "left").withColumn("problem", problem).drop("__n")


def identity_join(base: DataFrame, others: dict[str, DataFrame], index: str, name: str, versions: str = "version") -> DataFrame:
    """(name, source, problem) of what doesn't agree between `base` and each source of (index, name, version), all with a row for each parameter.

    Rows meet on the normalised name, never on the index: 'missing' (only in base), 'unknown'
    (only in the source), 'ambiguous' (more rows of a name), else 'index drift' and 'version
    drift' where the two differ. Names of `base` that normalise alike are ambiguous there.
    """
    key = normal_label(F.col(name)).alias("__k")
    left = base.groupBy(key).agg(F.min(name).alias("__n"), F.count("*").alias("__c"), F.min(index).alias("__i"), F.min(versions).alias("__v"))
    out = left.where("__c > 1").select(F.col("__n").alias("name"), F.lit("base").alias("source"), F.lit("ambiguous").alias("problem"))
    for source, df in others.items():
        right = df.groupBy(key).agg(F.min(name).alias("__m"), F.count("*").alias("__d"), F.min(index).alias("__j"), F.min(versions).alias("__w"))
        problem = (
            F.when(F.col("__d").isNull(), F.array(F.lit("missing"))).when(F.col("__c").isNull(), F.array(F.lit("unknown"))).when(F.col("__d") > 1, F.array(F.lit("ambiguous")))
            .otherwise(F.array_compact(F.array(F.when(~F.col("__i").eqNullSafe(F.col("__j")), "index drift"), F.when(~F.col("__v").eqNullSafe(F.col("__w")), "version drift"))))
        )
        met = left.join(right, "__k", "full").select(F.coalesce("__n", "__m").alias("name"), F.lit(source).alias("source"), F.explode(problem).alias("problem"))
        out = out.unionByName(met)
    return out


def in_range(df: DataFrame, x: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Join with half-open ranges lo <= x < hi; rows in no range stay, with nulls and the `problem` 'outside'. `ranges` has a row for each split or parameter and is broadcast."""
    met = df.join(F.broadcast(ranges), (F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi)), "left")
    return met.withColumn("problem", F.when(F.col(lo).isNull(), "outside"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` and the rows of `new` whose key it doesn't have; of new rows with equal key one."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def native_value(u: Column, low: Column, high: Column, kind: Column, choices: Column) -> Column:
    """A normalised value in a host's range: stepped categories by the nearest raw index, stepped numbers half-even, others in between."""
    lerp = low + u * (high - low)
    index = F.array_min(F.transform(choices, lambda v, i: F.struct(F.abs(v - u).alias("d"), i.alias("i"))))["i"]
    return F.when(kind == "category", low + index).when(kind == "stepped", F.bround(lerp)).otherwise(lerp)


#: Scores that are made at a time in a task, about.
TILE = 1 << 20


class Best:
    """The k best rows of each query, of scores to 12 digits, ties to the smaller id; rows come in any portions."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self, queries: np.ndarray) -> np.ndarray:
        """The score that a row needs at least; -inf while there are fewer than k."""
        return self.score[queries, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """scores: of the queries, by their numbers, with rows of these ids; of those good enough `wanted` may leave out more."""
        k, floor = self.k, self.floor(queries)
        if wanted is None and len(ids) > k and np.isneginf(floor).any():
            floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(scores >= floor[:, None] - 1e-11)
        score, to = np.round(scores[i, j], 12), queries[i]
        last = self.score[to, -1]
        good = (score > last) | ((score == last) & (ids[j] < self.ids[to, -1]))
        i, j, score = i[good], j[good], score[good]
        if wanted is not None and len(i):
            good = wanted(i, j)
            i, j, score = i[good], j[good], score[good]
        if not len(i):
            return
        some, place = np.unique(i, return_inverse=True)
        held = queries[some]
        place = np.concatenate([np.repeat(np.arange(len(some)), k), place])
        score, ids = np.concatenate([self.score[held].ravel(), score]), np.concatenate([self.ids[held].ravel(), ids[j]])
        order = np.lexsort((ids, -score, place))
        first = np.searchsorted(place[order], np.arange(len(some)))
        order = order[first[:, None] + np.arange(k)]
        self.score[held], self.ids[held] = score[order], ids[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores."""
        i, j = np.nonzero(np.isfinite(self.score))
        return i, self.ids[i, j], self.score[i, j]


#: Queries, and bytes of them, at most, that go to every task.
QUERIES = 131_072
QUERY_BYTES = 64 << 20


def _directions(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _compare(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """All queries with all rows, in tiles of about TILE scores."""
    for b in range(0, len(x), 4096):
        for a in range(0, len(q), TILE // 4096):
            best.add(np.arange(a, min(a + TILE // 4096, len(q))), q[a : a + TILE // 4096] @ x[b : b + 4096].T, ids[b : b + 4096])


def k_nearest(queries: DataFrame, vectors: DataFrame, k: int, *, block: int = QUERIES, chunk: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, cosine) of (query_id, q) in (vec_id, v), exact.

    Up to `block` queries, of QUERY_BYTES together, are broadcast and every task compares them
    with its own vectors. More of them meet the vectors in blocks: each block of queries with
    each chunk of vectors in a task, so rows of either side are sent once for every block of the
    other. A task holds a tile of scores and its best k rows of each query, which it passes on;
    the best of them win. Ties go to the smaller id. The work is all pairs.
    """
    schema = "query_id long, vec_id long, cosine double"
    n, values = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()

    def told(best: Best, ids: np.ndarray) -> pa.RecordBatch:
        i, found, score = best.rows()
        return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(found, pa.int64()), pa.array(score)], ["query_id", "vec_id", "cosine"])

    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    rows = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    if n <= block and 8 * values <= QUERY_BYTES:
        t = asked.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), _directions(t["q"])))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k)
            for b in batches:
                if b.num_rows and len(ids):
                    _compare(best, q, b.column(0).to_numpy(), _directions(b.column(1)))
            yield told(best, ids)

        found = rows.mapInArrow(near, schema)
    else:
        parts, chunks = -(-n // min(block, 65_536)), max(1, -(-vectors.count() // chunk))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), every(chunks).alias("chunk"))
        right = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), every(parts).alias("part"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            best = Best(a.num_rows, k)
            if a.num_rows and b.num_rows:
                _compare(best, _directions(a["q"]), b["vec_id"].to_numpy(), _directions(b["v"]))
            return pa.Table.from_batches([told(best, a["query_id"].to_numpy())])

        found = left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one pairing with the lowest total cost, by the method of Jonker and Volgenant.

    Prices of columns and rows are reduced first, and rows take columns that are then free of
    charge; what is left is paired along shortest augmenting paths.
    """
    n, m = cost.shape
    v = cost.min(axis=0) if n == m and n else np.zeros(m)  # with columns to spare, none may have a price
    u = (cost - v).min(axis=1) if n else np.zeros(n)
    match, paired = np.full(m, -1), np.zeros(n, dtype=bool)
    for row in range(n):
        for column in np.flatnonzero(cost[row] - v <= u[row]):
            if match[column] < 0:
                match[column], paired[row] = row, True
                break
    for row in np.flatnonzero(~paired):
        dist, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, low, column = row, 0.0, -1
        while True:
            slack = low + cost[at] - u[at] - v
            better = ~done & (slack < dist)
            dist[better], parent[better] = slack[better], column
            free = np.where(done, np.inf, dist)
            column = int(free.argmin())
            low = free[column]
            done[column] = True
            if match[column] < 0:
                break
            at = match[column]
        u[row] += low
        seen = done & (match >= 0)
        u[match[seen]] += low - dist[seen]
        v[done] += dist[done] - low
        while column >= 0:
            before = parent[column]
            match[column] = match[before] if before >= 0 else row
            column = before
    out = np.empty(n, dtype=int)
    out[match[match >= 0]] = np.flatnonzero(match >= 0)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and rows of b, by products: no array of all differences."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def pair_batches(df: DataFrame, batch: str, key: str, left: str, right: str) -> DataFrame:
    """(batch, key, paired, distance): in each batch `left` vectors are paired with `right` ones of other rows at the lowest total Euclidean distance.

    A batch is what one training step sees and so fits in a task: 2,048 rows take a matrix of
    32 MB. A task goes through its batches one after another.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(f[left].to_numpy()), np.stack(f[right].to_numpy())
        to = assignment(distances(a, b))
        gap = np.sqrt(((a - b[to]) ** 2).sum(axis=1))
        return pd.DataFrame({batch: f[batch].to_numpy(), key: f[key].to_numpy(), "paired": f[key].to_numpy()[to], "distance": gap})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            for name, part in f.groupby(batch, sort=False, dropna=False):
                before = held[-1][batch].iloc[0] if held else name
                if before != name and not (pd.isna(before) and pd.isna(name)):
                    yield solve(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield solve(pd.concat(held))

    rows = df.select(batch, key, left, right).repartition(batch).sortWithinPartitions(F.asc_nulls_last(batch), key)
    return rows.mapInPandas(run, f"{batch} {dict(df.dtypes)[batch]}, {key} long, paired long, distance double")


def sinkhorn(costs: DataFrame, iterations: int, reg: float) -> DataFrame:
    """(g, i, j, cost, p): soft assignments of each group g by alternating normalisation of rows and columns, in logarithms.

    A group is a full table of costs for i and j; it is one matrix in a task.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["i", "j"])
        x = -f["cost"].to_numpy().reshape(f["i"].nunique(), -1) / reg
        for _ in range(iterations):
            for axis in (1, 0):
                top = x.max(axis=axis, keepdims=True)
                x = x - top - np.log(np.exp(x - top).sum(axis=axis, keepdims=True))
        return f.assign(p=np.exp(x).ravel())

    kinds = dict(costs.dtypes)
    return costs.select("g", "i", "j", "cost").groupBy("g").applyInPandas(solve, f"g {kinds['g']}, i {kinds['i']}, j {kinds['j']}, cost double, p double")


def shuffled_partner(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, partner): a seeded permutation by hash order that leaves no row with itself, for two rows or more.

    Rows follow one another in a circle by their hash; each gets the key of the next one.
    """
    ordered = positions(df.select(key, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).alias("__h")), "__h")
    n = ordered.agg(F.count("*").alias("__n"))
    nxt = ordered.select(F.col(key).alias("partner"), F.col("i").alias("__to"))
    at = ordered.crossJoin(F.broadcast(n)).withColumn("__to", F.pmod(F.col("i") + 1, F.col("__n")))
    return at.join(nxt, "__to").select(key, "partner")


def shuffle_probe(df: DataFrame, group: str, key: str, settings: str, seed: int) -> DataFrame:
    """(group, key, partner, skipped): the seeded permutation of each group that may be probed, null partners and the reason for the others.

    A group is probed if it has two rows or more and all its rows have the same settings: only
    then a score must not depend on which prediction meets which target.
    """
    facts = df.groupBy(group).agg(F.count("*").alias("__n"), F.min(settings).alias("__lo"), F.max(settings).alias("__hi"), F.count(settings).alias("__s"))
    uniform = (F.col("__lo") == F.col("__hi")) & (F.col("__s") == F.col("__n")) | (F.col("__s") == 0)
    reason = F.when(F.col("__n") < 2, "too few rows").when(~F.coalesce(uniform, F.lit(False)), "settings differ")
    marked = df.select(group, key).join(facts.select(group, reason.alias("skipped")), group)
    # each row has a place in its group, and the partner is the row at the place that the permutation gives
    placed = group_positions(marked, group, key, seed)
    to = _partner_place("__i", "__n", F.lit(seed).cast("long"))
    there = placed.select(group, F.col(key).alias("partner"), F.col("__i").alias("__to"))
    asked = placed.withColumn("__to", F.when(F.col("skipped").isNull(), to))
    same = asked[group].eqNullSafe(there[group]) & (asked["__to"] == there["__to"])
    return asked.join(there, same, "left").select(asked[group], asked[key], "partner", "skipped")


#: Rows of a group that are numbered in one piece, about.
PLACES = 100_000


def group_positions(df: DataFrame, group: str, key: str, seed: int, per: int = PLACES) -> DataFrame:
    """Adds `__i`, a gapless place from 0 in each group, and `__n`, the group's rows; no task sees a group of more than about `per` rows.

    Rows are dealt to pieces by a hash of their key, pieces follow one another by their counts, and rows are numbered in their piece.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    pieces = F.ceil(F.col("__n") / per)
    sized = df.drop("__n").join(sizes, df[group].eqNullSafe(sizes[group])).drop(sizes[group])
    dealt = sized.withColumn("__p", F.pmod(F.xxhash64(key, F.lit(seed)), pieces))
    counts = dealt.groupBy(group, "__p").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # over pieces, not rows
    starts = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(before, F.lit(0)).alias("__s"))
    within = F.row_number().over(Window.partitionBy(group, "__p").orderBy(key))
    numbered = dealt.withColumn("__r", within)
    joined = numbered.join(starts, numbered[group].eqNullSafe(starts["__g"]) & (numbered["__p"] == starts["__q"]))
    return joined.withColumn("__i", F.col("__s") + F.col("__r") - 1).drop("__p", "__s", "__r", "__g", "__q")


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray, *, back: bool = False) -> np.ndarray:
    """A seeded permutation of 0 to n - 1, or its inverse: four Feistel rounds over the next even number of bits, again until the result is below n."""
    i, n, seed = (np.asarray(x).astype(np.uint64) for x in (i, n, seed))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2).astype(np.uint64)
    bits = np.where(n > np.uint64(1) << (np.uint64(2) * bits), bits + np.uint64(1), bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def mixed(x: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0x632BE59BD9B4E019 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))

    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        b, m, key = bits[todo], mask[todo], seed[todo]
        left, right = out[todo] >> b, out[todo] & m
        for turn in range(4):
            if back:
                left, right = right ^ (mixed(left, key, 3 - turn) & m), left
            else:
                left, right = right, left ^ (mixed(right, key, turn) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def partner_places(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each place the next one in a circle through all places in permuted order: a permutation that leaves none where it is, for two or more."""
    i, n = np.asarray(i, dtype=np.int64), np.asarray(n, dtype=np.int64)
    return permuted((permuted(i, n, seed) + 1) % np.maximum(n, 1), n, seed, back=True)


@F.pandas_udf(T.LongType())
def _partner_place(i: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(partner_places(i.to_numpy(), n.to_numpy(), seed.to_numpy()))


def checked_probe(probe: DataFrame) -> DataFrame:
    """The rows of a probe that was asked for by a seed: a reason to skip is an error when rows are read."""
    refused = F.raise_error(F.concat(F.lit("no shuffle probe: "), F.col("skipped"))).cast(dict(probe.dtypes)["partner"])
    return probe.withColumn("partner", F.when(F.col("skipped").isNotNull(), refused).otherwise(F.col("partner")))


def euclid(a: str, b: str) -> Column:
    return F.sqrt(A.total(A.squared_error(a, b)))
