"""Resharding that moves the fewest bytes, by minimum-cost flow from old shard sizes to new capacities."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowforge.llm._shared import delete, materialize

#: Blocks of an old shard. Their number bounds what the driver plans with: old shards * BLOCKS rows, however large the data.
BLOCKS = 4096
#: Pieces that a group is cut into which is larger than a new shard, for each shard that it would fill.
PIECES = 64
#: Bytes of a shard, about, that one task writes.
CHUNK = 32 << 20


def old_shard(key: Column, shards: int) -> Column:
    """The hash layout that is there before: a shard for each key."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def min_cost_flow(have: list[int], room: list[int]) -> list[list[int]]:
    """Bytes that go from each old shard to each new one: all of `have` in `room`, the fewest bytes moved.

    Keeping a byte in the shard of its number costs 0, moving it 1. Successive shortest
    augmenting paths with potentials over source, old shards, new shards and sink.
    """
    n, m = len(have), len(room)
    size = n + m + 2
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity, cost
    at: list[list[int]] = [[] for _ in range(size)]

    def add(u: int, v: int, capacity: int, cost: int) -> None:
        at[u].append(len(edges))
        edges.append([v, capacity, cost])
        at[v].append(len(edges))
        edges.append([u, 0, -cost])

    for i, h in enumerate(have):
        add(source, i, h, 0)
    for j, r in enumerate(room):
        add(n + j, sink, r, 0)
    for i, h in enumerate(have):
        for j in range(m):
            add(i, n + j, h, 0 if i == j else 1)
    price = [0] * size
    left = min(sum(have), sum(room))
    while left:
        dist, come = [None] * size, [-1] * size
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in at[u]:
                v, capacity, cost = edges[e]
                if capacity and (dist[v] is None or d + cost + price[u] - price[v] < dist[v]):
                    dist[v] = d + cost + price[u] - price[v]
                    come[v] = e
                    heapq.heappush(heap, (dist[v], v))
        if dist[sink] is None:
            break
        price = [p + d if d is not None else p for p, d in zip(price, dist, strict=True)]
        push, v = left, sink
        while v != source:
            push, v = min(push, edges[come[v]][1]), edges[come[v] ^ 1][0]
        v = sink
        while v != source:
            edges[come[v]][1] -= push
            edges[come[v] ^ 1][1] += push
            v = edges[come[v] ^ 1][0]
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in at[i]:
            if e % 2 == 0 and n <= edges[e][0] < n + m:
                flow[i][edges[e][0] - n] = edges[e ^ 1][1]
    return flow


def assign_blocks(old: np.ndarray, size: np.ndarray, shards: int, olds: int) -> np.ndarray:
    """New shard of each block: the flow's amounts, filled with whole blocks, the largest first.

    A block that fits in no amount left goes where most room is. Then blocks that move anyway
    even out the loads. So each old shard moves less than one block more than the flow.
    """
    have = np.bincount(old, weights=size, minlength=olds).astype(np.int64)
    total = int(size.sum())
    room = [total // shards + (j < total % shards) for j in range(shards)]
    flow = np.array(min_cost_flow([int(h) for h in have], room), dtype=np.int64).reshape(olds, shards)
    to = np.full(len(old), -1, dtype=np.int64)
    load = np.zeros(shards, dtype=np.int64)
    for b in np.lexsort((np.arange(len(old)), old, -size)):
        i, left = int(old[b]), flow[old[b]]
        j = i if i < shards and left[i] >= size[b] else int(left.argmax())
        if left[j] < size[b]:
            j = int((np.array(room) - load).argmax())
        else:
            left[j] -= size[b]
        to[b] = j
        load[j] += size[b]
    # single moved blocks from the fullest to the emptiest shard, as long as that narrows the spread
    moved = [sorted(np.flatnonzero((to == j) & (old != j)).tolist(), key=lambda b: size[b]) for j in range(shards)]
    for _ in range(20 * shards):
        lo = int(load.argmin())
        for hi in np.argsort(-load):
            gap = int(load[hi] - load[lo])
            k = int(np.searchsorted(size[moved[hi]], gap / 2, side="right")) - 1 if moved[hi] else -1
            if k >= 0 and size[moved[hi][k]] > 0:
                break
        else:
            break
        b = moved[hi].pop(k)
        if old[b] != lo:
            moved[lo].append(b)
            moved[lo].sort(key=lambda b: size[b])
        to[b] = lo
        load[hi] -= size[b]
        load[lo] += size[b]
    return to


def _laid(docs: DataFrame, olds: int, blocks: int, id_col: str, text_col: str, old: Column | None, *also: str) -> DataFrame:
    """(doc_id, size, key, old_shard, block), with `also` the text, of every row; `block` is a hash range of texts."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.xxhash64(F.md5(data)).alias("key"),
        F.col(text_col).alias("text"), *([] if old is None else [old.cast("int").alias("old_shard")]),
    )
    if old is None:
        rows = rows.withColumn("old_shard", old_shard(F.col("key"), olds))
    return rows.select("doc_id", "size", "key", "old_shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), *also)


_KEYS = ["old_shard", "block", "unit", "giant"]


def _pieces(laid: DataFrame, giants: DataFrame) -> DataFrame:
    """Adds piece (0 outside giants), giant (the key of one, else 0) and unit, which the plan puts somewhere as a whole."""
    out = laid.join(F.broadcast(giants), "key", "left")
    is_giant = F.col("pieces").isNotNull()
    return out.select(
        *laid.columns, F.when(is_giant, F.pmod(F.xxhash64("doc_id"), F.col("pieces")) + 1).otherwise(0).cast("int").alias("piece"),
        F.when(is_giant, F.col("key")).otherwise(0).alias("giant"), F.coalesce("cut", F.lit(False)).alias("cut"),
    ).withColumn("unit", F.when(F.col("cut"), F.col("piece")).when(F.col("giant") != 0, 1).otherwise(0)).drop("cut")


def reshard(
    docs: DataFrame, folder: str, *, shards: int = 24, olds: int = 20, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None,
    blocks: int = BLOCKS, live: bool = False,
) -> DataFrame:
    """Write the shards to `folder`/shard=N in slot order and read them back: (doc_id, text, slot, old_shard, shard), one row per input row. The law is `bytes`.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Before, rows lie in `olds`
    shards, by `old` or else by a hash of their text. Blocks (hash ranges of texts in an old
    shard, so equal texts stay together) go to `shards` new shards of nearly equal bytes; the
    blocks' sizes are all that the driver sees. That plan grows with the shards, not with the
    rows: at most BLOCKS sizes for an old shard and an edge for each old and new one, so it's
    meant for some hundreds of shards. A group of equal texts that is larger than a
    new shard is cut by id, as it fits in none; one that has more than a shard's share of rows
    is numbered in pieces. Slots are gapless from 0 in each shard, block by block, by id within
    a block; repeated and null ids get a slot each. Texts are shuffled once, to about CHUNK
    bytes for a task. An empty table gives an empty result; other columns aren't read.

    `live`: the folder is in use and has the old shards. Only shards that gain or lose rows
    are replaced, emptied ones deleted; other shards' files stay as they are, whatever their number.
    The result then has the rows of the shards that were written.
    """
    spark = docs.sparkSession
    schema = f"doc_id long, text {dict(docs.dtypes)[text_col]}, slot long, old_shard int"
    laid = materialize(_laid(docs, olds, blocks, id_col, text_col, old))
    total = laid.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("r")).first()
    if not total.r:
        return spark.createDataFrame([], schema + ", shard int")
    # fewer than shards + shards groups are that large, as each takes its share of bytes or rows
    giants = materialize(
        laid.groupBy("key")
        .agg(F.sum("size").alias("b"), F.count("*").alias("r"))
        .where((F.col("b") * shards > total.b) | (F.col("r") * shards > total.r))
        .select("key", (F.col("b") * shards > total.b).alias("cut"), (F.ceil(F.greatest(F.col("b") / total.b, F.col("r") / total.r) * shards) * PIECES).cast("int").alias("pieces"))
    )
    per_piece = materialize(_pieces(laid, giants).groupBy(*_KEYS, "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    sizes = per_piece.groupBy(*_KEYS).agg(F.sum("bytes").alias("bytes")).orderBy(*_KEYS).toPandas()
    was = sizes["old_shard"].to_numpy(np.int64)
    to = assign_blocks(was, sizes["bytes"].to_numpy(np.int64), shards, max(olds, int(was.max()) + 1))
    affected = sorted({*was[to != was].tolist(), *to[to != was].tolist()})
    sizes["shard"] = to.astype("int32")
    plan = spark.createDataFrame(sizes[[*_KEYS, "shard"]].astype({"old_shard": "int32", "block": "int32", "unit": "int32"}), "old_shard int, block int, unit int, giant long, shard int")
    first = Window.partitionBy("shard").orderBy("old_shard", "block", "giant", "unit", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_piece.join(F.broadcast(plan), _KEYS).select(
        *_KEYS, "piece", "shard", F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("start"),
        F.floor(F.coalesce(F.sum("bytes").over(first), F.lit(0)) / CHUNK).cast("int").alias("chunk"),
    )
    if live:
        starts = starts.where(F.col("shard").isin(affected))
    # starts has as many rows as the plan has blocks and pieces
    rows = _pieces(_laid(docs, olds, blocks, id_col, text_col, old, "text"), giants).join(F.broadcast(starts), [*_KEYS, "piece"])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.b // CHUNK))
    inside = Window.partitionBy("shard", "chunk", *_KEYS, "piece").orderBy("doc_id", "key")
    slots = rows.repartition(tasks, "shard", "chunk").withColumn("slot", (F.col("start") + F.row_number().over(inside) - 1).cast("long"))
    slots.select("doc_id", "text", "slot", "old_shard", "shard").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    if live:
        for n in set(affected) - set(to.tolist()):
            delete(spark, f"{folder}/shard={n}")
    back = spark.read.schema(schema + ", shard int").parquet(folder)
    return back.where(F.col("shard").isin(affected)) if live else back


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved) of the rows of written shards; text_crc32 is 0 for null and empty texts."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"),
    )
