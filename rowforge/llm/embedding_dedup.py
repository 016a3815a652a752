"""Near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import connected_components, joined_by_count, materialize, runs

#: Vectors of one block; two blocks meet in one task.
BLOCK = 8192
#: Children of a node above the blocks, at most.
PIVOTS = 64
#: Bytes of pivots of all nodes together that the driver holds and broadcasts, one round's at a time; nodes beyond it are cut by hash alone.
PIVOT_BYTES = 16 << 20
#: Groups with more rows than a block whose names are broadcast; more of them are joined by their counts.
MAX_GROUPS = 10_000
_ROWS = 1024


class CoverTree:
    """Nested levels over unit vectors: a node's children lie within its radius, which halves with each level.

    Nodes of a level are apart by more than the level's radius; a node is its own first child.
    `reach` is the distance from a node to its farthest descendant.
    """

    def __init__(self, x: np.ndarray, smallest: float):
        self.x = x
        self.smallest = smallest
        self.root = self._build(np.arange(len(x)), 2.0)

    def _build(self, rows: np.ndarray, radius: float) -> dict:
        """A node over rows, the first of which is its point."""
        reach = float(np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[rows] @ self.x[rows[0]])).max()))
        node = {"at": int(rows[0]), "rows": rows, "reach": reach, "children": None}
        if len(rows) > 32 and radius > self.smallest and reach > self.smallest / 2:
            half = radius / 2
            node["children"] = [self._build(rows[near], half) if len(near) > 1 else self._leaf(rows[near[0]]) for near in self._cover(rows, half)]
            node["points"] = np.array([c["at"] for c in node["children"]])
            node["reaches"] = np.array([c["reach"] for c in node["children"]])
        return node

    def _cover(self, rows: np.ndarray, half: float) -> Iterator[np.ndarray]:
        """Places in rows, by child: in their order, each point that no child holds yet takes all such points within `half` of it."""
        x = self.x[rows]
        free = np.ones(len(rows), dtype=bool)
        for start in range(0, len(rows), 256):
            some = start + np.flatnonzero(free[start : start + 256])
            close = 2 - 2 * (x[some] @ x.T) <= half * half
            for i, near in zip(some, close, strict=True):
                if free[i]:
                    near &= free
                    near[i] = False
                    free[near] = False
                    free[i] = False
                    yield np.concatenate([[i], np.flatnonzero(near)])

    @staticmethod
    def _leaf(i: int) -> dict:
        return {"at": int(i), "rows": np.array([i]), "reach": 0.0, "children": None}


def threshold_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i in a, j in b) with cosine at least `cosine`; pairs of nodes that are too far apart are never opened."""
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        if p["children"] is None and q["children"] is None:
            left, right = p["rows"], q["rows"]
            for k in range(0, len(left), _ROWS):
                i, j = np.nonzero(a.x[left[k : k + _ROWS]] @ b.x[right].T >= cosine)
                if len(i):
                    yield left[k : k + _ROWS][i], right[j]
            continue
        ps, pp, pr = _opened(p)
        qs, qp, qr = _opened(q)
        singles_i, singles_j = [], []
        for k in range(0, len(pp), _ROWS):
            dot = a.x[pp[k : k + _ROWS]] @ b.x[qp].T
            bound = limit + pr[k : k + _ROWS, None] + qr[None, :]
            i, j = np.nonzero(2 - 2 * dot <= bound * bound)
            for u, v in zip(i + k, j, strict=True):
                if pr[u] == 0 and qr[v] == 0 and len(ps[u]["rows"]) == 1 and len(qs[v]["rows"]) == 1:
                    if dot[u - k, v] >= cosine:
                        singles_i.append(pp[u])
                        singles_j.append(qp[v])
                else:
                    stack.append((ps[u], qs[v]))
        if singles_i:
            yield np.array(singles_i), np.array(singles_j)


def _opened(node: dict) -> tuple[list[dict], np.ndarray, np.ndarray]:
    if node["children"] is None:
        return [node], np.array([node["at"]]), np.array([node["reach"]])
    return node["children"], node["points"], node["reaches"]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Two vectors link when their labels are equal and not null and their cosine, in double
    precision, is at least `cosine`. Null, empty and zero vectors, vectors with null or
    non-finite components and null ids link with nothing; so do vectors of different length.
    n_links counts other rows linked directly (a row that repeats an id is another row);
    component_id is the smallest id reachable. Labels may be of any type that can be grouped.
    Only the three columns are read; an empty table gives an empty result.

    Vectors of a label are divided around pivots, in rounds, until a node has about `block` rows
    at most; nodes have a center and a covering radius, and two whose balls are farther apart
    than the limit never meet, nor does anything below them. Blocks that meet do so in one task:
    each becomes a cover tree, both are traversed together. A task gives a count for each vector and a spanning forest of its links, not
    the pairs. Where no balls can be separated (random directions), work per label grows
    with the square of its blocks, as the exact result then demands.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.select("vec_id", F.xxhash64("vec_id", "v").alias("tie"), F.concat_ws(":", F.size("v"), F.col("label").cast("string")).alias("grp"), "label", "v")
    # vectors of equal length and label make a group
    usable = materialize(base.where("vec_id is not null and label is not null and size(v) > 0").select("vec_id", "tie", "grp", "v").mapInArrow(_unit, _USABLE))
    sizes = materialize(usable.groupBy("grp").agg(F.count("*").alias("rows")))
    small = usable.join(sizes.where(F.col("rows") <= block), "grp", "left_semi").select(
        F.xxhash64("grp").alias("task"), "grp", F.lit(0).alias("side"), F.lit(1).alias("own"), "vec_id", "tie", "u"
    )
    large = sizes.where(F.col("rows") > block)
    if not large.isEmpty():
        small = small.unionByName(_met(usable, large, block, cosine))
    # a fixed number of partitions: a few tasks' vectors are few bytes, but much work
    tasks = small.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "side", "vec_id", "tie")
    found = materialize(tasks.mapInArrow(_compare(cosine), "kind string, vec_id long, tie long, grp string, n long"))
    links = found.where("kind = 'count'").groupBy("vec_id", "tie", "grp").agg(F.sum("n").alias("n_links"))
    # rows that repeat id and vector share a key, to which each adds the same count
    repeats = usable.groupBy("vec_id", "tie", "grp").agg(F.count("*").alias("m")).where("m > 1")
    links = links.join(repeats, ["vec_id", "tie", "grp"], "left").select("vec_id", "tie", "grp", F.expr("n_links div coalesce(m, 1)").alias("n_links"))
    components = connected_components(found.where("kind = 'link'").select(F.col("vec_id").alias("a"), F.col("n").alias("b")))
    rows = base.select("vec_id", "tie", "grp")
    return (
        rows.join(links, ["vec_id", "tie", "grp"], "left")
        .join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
        )
    )


_USABLE = "vec_id long, tie long, grp string, u array<double>"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; those with nulls, non-finite components or no length are left out."""
    for b in batches:
        out, keep = [], []
        for i, v in enumerate(b.column(3)):
            x = v.values
            if x.null_count:
                continue
            x = x.to_numpy(zero_copy_only=False)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                out.append(x / np.sqrt(x @ x))
                keep.append(i)
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(out) if out else np.empty(0))
        rest = [b.column(k).take(pa.array(keep, pa.int64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*rest, lists], ["vec_id", "tie", "grp", "u"])


def _met(usable: DataFrame, large: DataFrame, block: int, cosine: float) -> DataFrame:
    """(task, grp, side, own, vec_id, tie, u) of groups with more rows than a block: a task for each two blocks that may have links.

    The top of a cover tree over each group, in rounds: the rows of a node with more than a block
    go to the nearest of its pivots, which become its children, until nodes are small enough.
    A node's ball has its pivot for center and its farthest vector's distance for radius. Pairs
    of nodes descend from the roots, and only those whose balls may hold a link are opened.
    """
    spark = usable.sparkSession
    limit = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    few = large.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    wanted = large.select("grp", F.xxhash64("grp").alias("node"), F.col("rows").alias("__m"))
    rows = (usable.join(F.broadcast(wanted), "grp") if few else joined_by_count(usable, wanted, "grp", "__m", prune=False)).drop("__m")
    placed = rows.select("vec_id", "tie", "grp", "u", "node", F.lit(2.0).alias("dist"))
    longest = usable.agg(F.max(F.size("u"))).first()[0] or 1
    room = PIVOT_BYTES // (8 * longest)
    levels: list[DataFrame] = []
    centers: list[tuple[int, int, list[float]]] = []
    most: list[tuple[int, int]] = []
    while True:
        placed = materialize(placed)
        sizes = materialize(placed.groupBy("node").agg(F.first("grp").alias("grp"), F.count("*").alias("rows"), F.max("dist").alias("reach")))
        # balls smaller than a link needn't be divided: all their rows may be linked
        # and a child with nearly all rows of its parent isn't divided again
        bound = F.broadcast(spark.createDataFrame(most, "node long, most long"))
        open_ = sizes.where((F.col("rows") > block) & (F.col("reach") > limit / 2)).join(bound, "node", "left").where("rows <= coalesce(most, rows)")
        open_ = open_.orderBy(F.desc("rows"), "node").limit(max(0, room // PIVOTS)).select("node", "rows", F.least(F.ceil(F.col("rows") / block), F.lit(PIVOTS)).cast("int").alias("slots"))
        slot = F.pmod(F.xxhash64("vec_id", F.lit(1), "node"), F.col("slots")).alias("slot")
        pivots = placed.join(F.broadcast(open_), "node").groupBy("node", "rows", slot).agg(F.min_by("u", F.struct(F.xxhash64("vec_id"), "tie")).alias("u"))
        found = pivots.select("node", "rows", F.xxhash64("node", "slot").alias("child"), "u").orderBy("node", "child").collect()  # no more than `room` of them
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r.node, []).append((r.child, r.u))
        by_node = {n: c for n, c in by_node.items() if len(c) > 1}
        most = [(r.child, r.rows * 9 // 10) for r in found]
        listed = spark.createDataFrame([(n, True) for n in by_node], "node long, open boolean")
        levels.append(sizes.join(F.broadcast(listed), "node", "left").withColumn("open", F.coalesce("open", F.lit(False))))
        if not by_node:
            break
        room -= sum(map(len, by_node.values()))
        centers += [(n, c, u) for n, cs in by_node.items() for c, u in cs]
        placed = placed.mapInArrow(_placer(spark.sparkContext.broadcast({n: (np.array([c for c, _ in cs]), np.array([u for _, u in cs])) for n, cs in by_node.items()})), _USABLE + ", node long, dist double")
    # a leaf is there in every later round, too
    tree = reduce(DataFrame.unionByName, levels)
    nodes = materialize(tree.groupBy("node").agg(F.first("grp").alias("grp"), F.max("rows").alias("rows"), F.max("reach").alias("reach"), F.max("open").alias("open")))
    pairs = large.select(F.xxhash64("grp").alias("a"), F.xxhash64("grp").alias("b"))
    if centers:
        held = spark.createDataFrame(centers, "parent long, child long, center array<double>")
        known = nodes.select(F.col("node").alias("child"), "reach")
        below = held.join(known, "child").select("parent", F.col("child").alias("next"), "center", "reach", F.lit(False).alias("same"))
        leaves = nodes.where("not open").join(held.select(F.col("child").alias("node"), "center"), "node", "left").select(F.col("node").alias("parent"), F.col("node").alias("next"), "center", "reach", F.lit(True).alias("same"))
        steps = materialize(below.unionByName(leaves))
        left, right = (steps.select(F.col("parent").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("next", "center", "reach", "same"))) for n in ("a", "b"))
        dot = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        near = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("reach_a") + F.col("reach_b") + limit
        keep = F.col("center_a").isNull() | F.col("center_b").isNull() | near
        while True:
            opened = pairs.join(left, "a").join(right, "b").where(keep)
            # a node with itself gives each two children once
            opened = opened.where((F.col("a") != F.col("b")) | (F.col("next_a") <= F.col("next_b")))
            pairs = materialize(opened.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), (F.col("same_a") & F.col("same_b")).alias("done")))
            if pairs.where("not done").isEmpty():
                break
            pairs = pairs.select("a", "b")
    cuts = nodes.where("not open").select("node", "grp", F.ceil(F.col("rows") / block).cast("int").alias("cuts"))
    a, b = (cuts.select(F.col("node").alias(n), *([F.col("grp")] if n == "a" else []), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias(f"k{n}")) for n in ("a", "b"))
    meets = pairs.select("a", "b").join(a, "a").join(b, "b").where("a <> b or ka <= kb")
    meets = meets.withColumn("task", F.xxhash64("a", "ka", "b", "kb")).withColumn("own", F.expr("cast(a = b and ka = kb as int)"))
    meets = materialize(meets.select("task", "a", "ka", "b", "kb", "own"))
    first = meets.select("task", F.col("a").alias("node"), F.col("ka").alias("cut"), F.lit(0).alias("side"), "own")
    second = meets.where("own = 0").select("task", F.col("b").alias("node"), F.col("kb").alias("cut"), F.lit(1).alias("side"), "own")
    counted = nodes.where("not open").select("node", F.col("rows").alias("__m"), F.ceil(F.col("rows") / block).cast("int").alias("cuts"))
    dealt = (placed.join(F.broadcast(counted), "node") if nodes.count() <= MAX_GROUPS else joined_by_count(placed, counted, "node", "__m", prune=False)).drop("__m")
    dealt = materialize(dealt.withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit(2)), "cuts").cast("int")).drop("cuts", "dist"))
    return dealt.join(first.unionByName(second), ["node", "cut"]).select("task", "grp", "side", "own", "vec_id", "tie", "u")


def _placer(shared):
    """Rows of a node that has children go to the nearest; others stay."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, dist = b.column(4).to_numpy().copy(), b.column(5).to_numpy().copy()
            for n in np.unique(node):
                if n in shared.value:
                    children, centers = shared.value[n]
                    at = np.flatnonzero(b.column(4).to_numpy() == n)
                    u = b.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                    dot = u @ centers.T
                    node[at] = children[dot.argmax(axis=1)]
                    dist[at] = np.sqrt(np.maximum(0.0, 2 - 2 * dot.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(node), pa.array(dist)], b.schema.names)

    return place


def _compare(cosine: float):
    smallest = float(np.sqrt(2 - 2 * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["task"]):
            side, ids, tie = t["side"].to_numpy(), t["vec_id"].to_numpy(), t["tie"].to_numpy()
            own, grp = bool(t["own"][0].as_py()), t["grp"][0].as_py()
            x = t["u"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            if own:
                where = [np.arange(len(ids))] * 2
                trees = [CoverTree(x, smallest)] * 2
            else:
                where = [np.flatnonzero(side == s) for s in (0, 1)]
                trees = [CoverTree(x[w], smallest) for w in where]
            count = np.zeros(len(ids), dtype=np.int64)
            up = list(range(len(ids)))

            def root(i: int, up: list[int] = up) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            links = []
            for i, j in threshold_pairs(*trees, cosine):
                i, j = where[0][i], where[1][j]
                if own:
                    i, j = i[i != j], j[i != j]
                np.add.at(count, i, 1)
                if not own:
                    np.add.at(count, j, 1)
                for u, v in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = root(u), root(v)
                    if a != b:
                        up[a] = b
                        links.append((u, v))
            some = np.flatnonzero(count)
            if len(some):
                u, v = (np.array(c, dtype=np.int64) for c in zip(*links, strict=True))
                k = len(u)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["count"] * len(some) + ["link"] * k),
                        pa.array(np.concatenate([ids[some], ids[u]])),
                        pa.array(np.concatenate([tie[some], tie[u]])),
                        pa.array([grp] * (len(some) + k)),
                        pa.array(np.concatenate([count[some], ids[v]])),
                    ],
                    ["kind", "vec_id", "tie", "grp", "n"],
                )

    return run
