"""Hard negatives by a geometric near-neighbour access tree: multiway hyperplane splits with distance ranges to sibling subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm._shared import joined_by_count, materialize

#: Rows of one tree, about, and of a leaf; subtrees of a node.
BLOCK = 8192
LEAF = 256
WAYS = 16
#: Regions that a group with more rows than a block is divided into, at most, before its trees are built.
REGIONS = 64
#: Bytes of split points of all groups together that the driver holds and broadcasts; groups beyond it are divided by hash alone.
SPLIT_BYTES = 4 << 20
#: Anchors that search a tree together.
ASKED = 256
#: Regions whose numbers of trees are broadcast; more of them are joined by count.
BROADCAST_REGIONS = 100_000
_EXACT = 2.0**53


class Gnat:
    """A tree over the rows of one block. Each row goes to its nearest split point; of each split point the node keeps the least and the largest
    distance to the rows of every subtree.

    Rows get one more coordinate that gives all of them the same length, and anchors get 0 there.
    Then a score (inner product) is a distance, the larger the nearer, and a window of scores is
    an annulus around the anchor.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, ways: int = WAYS):
        self.x, self.leaf, self.ways = x, leaf, ways
        square = np.einsum("ij,ij->i", x, x)
        self.length2 = float(square.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(0.0, self.length2 - square))
        self.root = self._node(np.arange(len(x)))

    def _gaps(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        dot = self.x[rows] @ self.x[points].T + np.outer(self.extra[rows], self.extra[points])
        return np.sqrt(np.maximum(0.0, 2 * self.length2 - 2 * dot))

    def _node(self, rows: np.ndarray) -> dict:
        if len(rows) <= self.leaf:
            return {"rows": rows}
        points = self._points(rows)
        gaps = self._gaps(rows, points)
        near = gaps.argmin(axis=1)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=len(points))
        if counts.max() == len(rows):  # nothing parts them: copies of one row
            return {"rows": rows}
        keep = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[keep])[:-1]])
        low, high = np.minimum.reduceat(gaps[order], starts, axis=0).T, np.maximum.reduceat(gaps[order], starts, axis=0).T
        kids = [self._node(rows[order[s : s + n]]) for s, n in zip(starts, counts[keep], strict=True)]
        return {"points": points, "own": keep, "low": low, "high": high, "kids": kids}

    def _points(self, rows: np.ndarray) -> np.ndarray:
        """Split points far from each other: each is the farthest from those before it, of a spread of the rows."""
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 4 * self.ways)).astype(int)]
        at, gap = [0], np.full(len(some), np.inf)
        while len(at) < self.ways:
            gap = np.minimum(gap, self._gaps(some, some[at[-1:]])[:, 0])
            at.append(int(gap.argmax()))
            if gap[at[-1]] == 0:
                at.pop()
                break
        return some[at]


def crossed(gaps: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """For each query and subtree, whether the subtree may hold a row in the query's annulus from `near` to `far`.

    `gaps`: queries x split points; `low` and `high`: split points x subtrees. By the triangle
    inequality a row in [low, high] of a point is between max(gap - high, low - gap) and
    gap + high from the query.
    """
    least = np.maximum(gaps[:, :, None] - high[None], low[None] - gaps[:, :, None]).max(axis=1)
    most = (gaps[:, :, None] + high[None]).min(axis=1)
    return (least <= (far + slack)[:, None]) & (most >= (near - slack)[:, None])


def _radius(square: np.ndarray, length2: float, score: np.ndarray) -> np.ndarray:
    """Distance from anchors of that squared length to rows of that score."""
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(0.0, square + length2 - 2 * score))


class Asked:
    """Anchors and their windows of scores, with the best rows found so far: highest scores first, ties by smaller id."""

    def __init__(self, anchors: np.ndarray, rid: np.ndarray, label: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.a, self.rid, self.label, self.of, self.low, self.high, self.same = anchors, rid, label, of, low, high, same_label
        self.square = np.einsum("ij,ij->i", anchors, anchors)
        self.score = np.full((len(of), k), -np.inf)
        self.id = np.full((len(of), k), np.iinfo(np.int64).max)
        self.at = np.full((len(of), k), -1)

    def search(self, tree: Gnat, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> None:
        """ids are in ascending order, so that the first of equal scores is the one to take."""
        todo = [(tree.root, np.arange(len(self.of)))]
        while todo:
            node, w = todo.pop()
            if not len(w):
                continue
            if "rows" in node:
                for s in range(0, len(node["rows"]), 1024):
                    self._leaf(tree.x, np.sort(node["rows"][s : s + 1024]), w, ids, rids, labels)
                continue
            who, back = np.unique(self.of[w], return_inverse=True)
            dot = self.a[who] @ tree.x[node["points"]].T
            gaps = np.sqrt(np.maximum(0.0, self.square[who, None] + tree.length2 - 2 * dot))[back]
            square = self.square[self.of[w]]
            slack = 1e-6 * (1 + np.sqrt(square) + np.sqrt(tree.length2))
            near = _radius(square, tree.length2, self.high[w])
            far = _radius(square, tree.length2, np.maximum(self.low[w], self.score[w, -1]))
            hit = crossed(gaps, node["low"], node["high"], near, far, slack)
            # what is put last is searched first: subtrees whose split points are near to most windows
            order = np.argsort(-gaps.mean(axis=0)[node["own"]], kind="stable")
            todo += [(node["kids"][j], w[hit[:, j]]) for j in order]

    def _leaf(self, x: np.ndarray, rows: np.ndarray, w: np.ndarray, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> None:
        who, back = np.unique(self.of[w], return_inverse=True)
        s = self.a[who] @ x[rows].T
        fits = labels[rows][None, :] == self.label[who][:, None]
        fits = (fits & (rids[rows][None, :] != self.rid[who][:, None])) if self.same else ~fits
        least = np.maximum(self.low[w], self.score[w, -1])
        ok = fits[back] & (s[back] >= least[:, None]) & (s[back] <= self.high[w][:, None])
        some = np.flatnonzero(ok.any(axis=1))
        if not len(some):
            return
        v, k = w[some], self.score.shape[1]
        found = np.where(ok[some], s[back[some]], -np.inf)
        if found.shape[1] > k:  # the k best of the leaf: rows are in order of ids, and the sort is stable
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            found, picked = np.take_along_axis(found, best, axis=1), rows[best]
        else:
            picked = np.broadcast_to(rows, found.shape)
        score = np.concatenate([self.score[v], found], axis=1)
        id_ = np.concatenate([self.id[v], np.where(np.isfinite(found), ids[picked], np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((id_, -score), axis=1)[:, :k]
        self.score[v], self.id[v] = np.take_along_axis(score, order, axis=1), np.take_along_axis(id_, order, axis=1)


_ROWS = "rid long, vec_id long, label long, grp string, region int, x array<double>"
_FOUND = "rid long, w int, score long, vec_id long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(rid, vec_id, label, dim, x): rows that take part, x the floor of scale times each component; rid tells rows apart that repeat an id."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`")
    whole = dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), (label.cast("long") if whole else F.when(label.isNotNull(), F.xxhash64(label))).alias("label"), v.alias("v")
    ).where("vec_id is not null and label is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.size("v").alias("dim"), x.alias("x"))


class _Regions:
    """The top of the trees of large groups: split points, and distance ranges from each to what the others' regions hold."""

    def __init__(self, rows: DataFrame, block: int, split_bytes: int = SPLIT_BYTES):
        """rows: (rid, vec_id, label, grp, x). Gives `placed`, the rows with their region, and `blocks`, how many trees a region is cut into."""
        spark = rows.sparkSession
        self.large: dict[str, dict] = {}
        sizes = materialize(rows.groupBy("grp").agg(F.count("*").alias("m"), F.max(F.size("x")).alias("dim"), F.max(F.expr("aggregate(x, 0D, (s, c) -> s + c * c)")).alias("length2")))
        large = sizes.where(F.col("m") > block).orderBy("grp")
        longest = large.agg(F.max("dim")).first()[0]
        wanted = large.select("grp", "length2", F.least(F.ceil(F.col("m") / block), F.lit(REGIONS)).cast("int").alias("slots"))
        if longest:
            wanted = wanted.limit(max(1, split_bytes // (8 * REGIONS * (longest + 2 * REGIONS))))
            slot = F.pmod(F.xxhash64("rid"), F.col("slots")).alias("slot")
            points = rows.join(F.broadcast(wanted), "grp").groupBy("grp", slot).agg(F.min_by("x", F.xxhash64("rid", F.lit(1))).alias("x"), F.max("length2").alias("length2"))
            by_group: dict[str, list] = {}
            for r in points.orderBy("grp", "slot").collect():
                by_group.setdefault(r.grp, [r.length2]).append(r.x)
            for g, (length2, *x) in by_group.items():
                x = np.array(x)
                self.large[g] = {"length2": length2, "x": x, "extra": np.sqrt(np.maximum(0.0, length2 - np.einsum("ij,ij->i", x, x)))}
        if not self.large:
            self.placed = rows.withColumn("region", F.lit(0)).select("rid", "vec_id", "label", "grp", "region", "x")
        else:
            held = spark.sparkContext.broadcast(self.large)
            self.placed = materialize(rows.select("rid", "vec_id", "label", "grp", "x").mapInArrow(_placer(held), _ROWS))
            gaps = self.placed.select("grp", "region", "x").mapInArrow(_ranges(held), "grp string, region int, point int, low double, high double")
            for r in gaps.groupBy("grp", "region", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
                g = self.large[r.grp]
                shape = (len(g["x"]), len(g["x"]))
                g.setdefault("low", np.full(shape, np.inf))[r.point, r.region] = r.low
                g.setdefault("high", np.full(shape, -np.inf))[r.point, r.region] = r.high
        self.held = spark.sparkContext.broadcast(self.large)
        counted = self.placed.groupBy("grp", "region").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        self.blocks = materialize(counted.select(_place(), "n", "blocks"))
        self.few = self.blocks.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS

    def with_blocks(self, df: DataFrame, places: DataFrame | None = None) -> DataFrame:
        """df and the number of trees of each row's region, of those in `places` alone."""
        blocks = self.blocks if places is None else self.blocks.join(places, "place", "left_semi")
        keyed = df.withColumn("place", _place())
        return keyed.join(F.broadcast(blocks), "place") if self.few else joined_by_count(keyed, blocks, "place")


def _place() -> Column:
    return F.concat_ws("/", "region", "grp").alias("place")


def _with_gaps(g: dict, x: np.ndarray) -> np.ndarray:
    """Distances of rows to a group's split points."""
    extra = np.sqrt(np.maximum(0.0, g["length2"] - np.einsum("ij,ij->i", x, x)))
    return np.sqrt(np.maximum(0.0, 2 * g["length2"] - 2 * (x @ g["x"].T + np.outer(extra, g["extra"]))))


def _by_group(grps: pa.Array, x: pa.Array, large: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    names = np.array(grps.to_pylist(), dtype=object)
    for g in dict.fromkeys(names):
        if g in large:
            at = np.flatnonzero(names == g)
            yield g, at, _matrix(x.take(pa.array(at)))


def _placer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = np.zeros(b.num_rows, dtype=np.int32)
            for g, at, x in _by_group(b.column(3), b.column(4), held.value):
                region[at] = _with_gaps(held.value[g], x).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(region), b.column(4)], ["rid", "vec_id", "label", "grp", "region", "x"])

    return run


def _ranges(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regions = b.column(1).to_numpy()
            for g, at, x in _by_group(b.column(0), b.column(2), held.value):
                gaps = _with_gaps(held.value[g], x)
                for r in np.unique(regions[at]):
                    mine = gaps[regions[at] == r]
                    m = mine.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * m), pa.array(np.full(m, r, dtype=np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(mine.min(axis=0)), pa.array(mine.max(axis=0))],
                        ["grp", "region", "point", "low", "high"],
                    )

    return run


_ASKED = "rid long, vec_id long, label long, grp string, x array<double>, low array<double>, high array<double>"


def _routed(regions: _Regions, asked: DataFrame, part: str) -> DataFrame:
    """Anchors with each region that may hold a row in one of their windows; part: 'home' for the nearest alone, 'rest' for all others, 'all'."""
    held = regions.held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found_at, found_region = [], []
            grps = np.array(b.column(3).to_pylist(), dtype=object)
            for g in dict.fromkeys(grps):
                at = np.flatnonzero(grps == g)
                top = held.value.get(g)
                if top is None:
                    if part != "rest":
                        found_at.append(at)
                        found_region.append(np.zeros(len(at), dtype=np.int32))
                    continue
                a = _matrix(b.column(4).take(pa.array(at)))
                square = np.einsum("ij,ij->i", a, a)
                gaps = np.sqrt(np.maximum(0.0, square[:, None] + top["length2"] - 2 * (a @ top["x"].T)))
                home = gaps.argmin(axis=1)
                hit = np.zeros(gaps.shape, dtype=bool)
                if part == "home":
                    hit[np.arange(len(at)), home] = True
                else:
                    slack = 1e-6 * (1 + np.sqrt(square) + np.sqrt(top["length2"]))
                    for k, i in enumerate(at):
                        low, high = (np.array(b.column(c)[int(i)].as_py(), dtype=float) for c in (5, 6))
                        m = len(low)
                        far = np.where(np.isfinite(low), _radius(square[k], top["length2"], low), np.inf)
                        near = np.where(np.isfinite(high), _radius(square[k], top["length2"], high), 0.0)
                        hit[k] = crossed(np.repeat(gaps[k : k + 1], m, axis=0), top["low"], top["high"], near, far, np.full(m, slack[k])).any(axis=0)
                    if part == "rest":
                        hit[np.arange(len(at)), home] = False
                i, r = np.nonzero(hit)
                found_at.append(at[i])
                found_region.append(r.astype(np.int32))
            take = np.concatenate(found_at) if found_at else np.empty(0, dtype=int)
            t = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.concatenate(found_region) if found_region else np.empty(0, np.int32))], [*b.schema.names, "region"])

    return asked.mapInArrow(run, _ASKED + ", region int")


def _search(regions: _Regions, asked: DataFrame, part: str, k: int, same_label: bool) -> DataFrame:
    """(rid, w, score, vec_id): of each anchor and window the best k rows of every tree that it searches."""
    spark = asked.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = regions.with_blocks(_routed(regions, asked, part))
    wanted = materialize(routed.withColumn("piece", F.explode(F.expr("sequence(0, blocks - 1)"))))
    used = wanted.select("place").distinct()
    none = F.lit(None).cast("array<double>")
    rows = regions.with_blocks(regions.placed, used).withColumn("piece", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("blocks")).cast("int"))
    task = F.xxhash64("place", "piece").alias("task")
    columns = [task, "side", "vec_id", "rid", "label", "x", "low", "high"]
    both = rows.withColumn("side", F.lit(0)).withColumn("low", none).withColumn("high", none).select(columns).unionByName(wanted.withColumn("side", F.lit(1)).select(columns))
    dealt = both.repartition(parts, "task").sortWithinPartitions("task", "side", "vec_id", "rid")
    return dealt.mapInArrow(_searcher(k, same_label), _FOUND)


def _searcher(k: int, same_label: bool):
    def answers(tree: Gnat, rows: pa.Table, b: pa.Table) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in b["low"]])
        of = np.repeat(np.arange(b.num_rows), sizes)
        w = np.concatenate([np.arange(s) for s in sizes])
        flat = [b[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("low", "high")]
        anchors = _matrix(b["x"])
        if (limit := max(np.abs(tree.x).max(initial=0), np.abs(anchors).max(initial=0)) ** 2 * anchors.shape[1]) >= _EXACT:
            raise ValueError(f"scores may reach {limit:.3g}; beyond 2**53 they aren't exact: use a smaller scale")
        asked = Asked(anchors, b["rid"].to_numpy(), b["label"].to_numpy(), of, *flat, k, same_label)
        asked.search(tree, rows["vec_id"].to_numpy(), rows["rid"].to_numpy(), rows["label"].to_numpy())
        i, j = np.nonzero(np.isfinite(asked.score))
        return pa.RecordBatch.from_arrays(
            [pa.array(b["rid"].to_numpy()[of[i]]), pa.array(w[i], pa.int32()), pa.array(asked.score[i, j].astype(np.int64)), pa.array(asked.id[i, j])],
            ["rid", "w", "score", "vec_id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows come first and become a tree; its anchors follow, some at a time, however many there are."""
        task, held, tree, rows = None, [], None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            tasks, sides = t["task"].to_numpy(), t["side"].to_numpy()
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1), t.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                piece = t.slice(s, e - s)
                own, side = piece["task"][0].as_py(), piece["side"][0].as_py()
                if own != task:
                    task, held, tree = own, [], None
                if side == 0:
                    held.append(piece)
                    continue
                if tree is None and held:
                    rows = pa.concat_tables(held)
                    tree, held = Gnat(_matrix(rows["x"])), []
                for i in range(0, piece.num_rows if tree is not None else 0, ASKED):
                    yield answers(tree, rows, piece.slice(i, ASKED).combine_chunks())

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window; each task passes on no more than k before the shuffle."""
    w = Window.partitionBy("rid", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); the score of two rows is their integer inner product.
    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its first
    `positives` other rows of the same label, higher scores first, ties by smaller id. For each,
    the negatives are the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; rank counts from 1.
    Fewer are given where there are no more; an anchor without positives has no rows.

    Rows with a null id, a null label, a null or empty vector or a null or non-finite component
    take no part; vectors of different length don't meet. Rows that repeat an id are rows of
    their own, as anchors too (each then has its rows), and may be each other's positives. Scores
    beyond 2**53 are refused. Only the three columns are read; an empty table gives no rows.

    A group (rows of one length, and for positives of one label) with more than `block` rows is
    divided around split points, and each region into trees of about `block` rows. Anchors go to
    the regions, and in a tree to the subtrees, whose distance ranges cross the annulus of their
    window; leaves are compared exactly. For positives of large groups the anchor's own region
    is searched first, so that the annulus is small for the others. Where distances are all
    alike, as with random directions, every anchor searches every tree, as the exact result then
    demands: the anchors' share of the rows times all rows, by matrix products.
    """
    usable = materialize(quantised(vectors, id_col, vector_col, label_col, scale))
    inf = float("inf")
    is_anchor = F.col("vec_id") % every == 0
    anchors = usable.where(is_anchor)
    by_label = F.concat_ws(":", "dim", "label").alias("grp")
    # groups without an anchor have no part in the first search
    with_anchor = materialize(anchors.select(by_label).distinct())
    grouped = usable.select("rid", "vec_id", "label", by_label, "x").join(with_anchor, "grp", "left_semi").select("rid", "vec_id", "label", "grp", "x")
    regions = _Regions(materialize(grouped), block)
    open_window = lambda least: (F.array(least).alias("low"), F.array(F.lit(inf)).alias("high"))
    asked = materialize(anchors.select("rid", "vec_id", "label", by_label, "x", *open_window(F.lit(-inf))))
    found = materialize(_best(_search(regions, asked, "home", positives, True), positives))
    if regions.large:
        least = found.where(F.col("rank") == positives).select("rid", F.col("score").cast("double").alias("least"))
        again = asked.drop("low", "high").join(least, "rid", "left").select("rid", "vec_id", "label", "grp", "x", *open_window(F.coalesce("least", F.lit(-inf))))
        more = _search(regions, again, "rest", positives, True)
        found = materialize(_best(found.drop("rank").unionByName(more), positives))
    pairs = found.select("rid", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    by_length = F.col("dim").cast("string").alias("grp")
    windows = pairs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("ps"))
    hundredth = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("double")  # noqa: E731  rounded down, exactly
    lows = F.transform("ps", lambda s: -hundredth(s["positive_score"] * -low)).alias("low")
    highs = F.transform("ps", lambda s: hundredth(s["positive_score"] * high)).alias("high")
    asked = materialize(anchors.join(windows, "rid").select("rid", "vec_id", "label", by_length, "x", lows, highs))
    regions = _Regions(usable.select("rid", "vec_id", "label", by_length, "x"), block)
    negative = _best(_search(regions, asked, "all", negatives, False), negatives)
    return (
        negative.join(pairs, ["rid", "w"])
        .join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
    )
