"""Near-duplicate groups of documents by bottom-k sketches of word-shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import connected_components, filtered, id_filter, joined_by_count, materialize, runs, shingle_set, without_ids

#: Values of one hash function that a sketch retains.
SKETCH = 32
#: Values of the sketches by which members of large cells are divided again.
FINE = 256
#: Texts compared by one call in a task.
BLOCK = 256
#: Shingles of a block's texts together, about, at most.
BLOCK_SHINGLES = 1 << 21
_SKETCHED = "doc_id long, n_shingles long, set_key string, sketch array<long>"
_FOUND = "kind string, leader long, block long, a long, b long, distance double"


def loose(threshold: float, k: int = SKETCH) -> float:
    """Share of retained values that two linked sets have in common at least: 5.4 standard deviations below the threshold."""
    return max(1 / k, threshold - 5.4 * math.sqrt(threshold * (1 - threshold) / k))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch): set_key digests the whole set, sketch has its `size` smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, parts = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                parts.append(s[:size])
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(parts) if parts else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), lists], ["doc_id", "n_shingles", "set_key", "sketch"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCHED)


def _prefix(size: Column, threshold: float, k: int) -> Column:
    """How many of a sketch's values, rarest first, must meet those of any linked set.

    A set that is small enough to be, like all its partners, whole in its sketch shares at
    least threshold * size values; others share at least loose(threshold) * size retained ones.
    """
    least = F.when(size <= F.lit(math.floor(threshold * k)), F.ceil(size * threshold - 1e-9)).otherwise(F.floor(size * loose(threshold, k)))
    return size - F.greatest(least, F.lit(1)) + 1


def cells(sets: DataFrame, threshold: float, k: int = SKETCH) -> DataFrame:
    """(leader, rep, n): every two linked sets are together in some cell; a cell has its leader too. n is the set's size.

    Inverted lists hold the retained values that more than one set has. Of its own, a set
    keeps only the rarest, as many as the least overlap demands, so that passages which many
    documents share make no long lists. Lists with the same leader (the set with the most
    shared values) are one cell. Rows grow with the input, not with the square of a list; the
    rows of a value that is common all the same are joined where they are.
    """
    posts = sets.select("rep", F.col("n_shingles").alias("n"), F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    counts = posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = joined_by_count(posts, counts, "v", "c").groupBy("rep", "n", "size").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("found"))
    alone = F.col("size") - F.size("found")
    keys = materialize(
        shared.withColumn("alone", alone)
        .withColumn("left", (_prefix(F.col("size"), threshold, k) - F.col("alone")).cast("int"))
        .where("left > 0")
        .select("rep", "n", "alone", F.explode(F.slice("found", F.lit(1), F.col("left"))).alias("f"))
        .select("rep", "n", "alone", F.col("f.v").alias("v"))
    )
    leaders = keys.groupBy("v").agg(F.min(F.struct("alone", "rep")).alias("m"), F.count("*").alias("c")).where("c > 1")
    return joined_by_count(keys, leaders, "v", "c").select(F.col("m.rep").alias("leader"), "rep", "n").distinct()


def _divided(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, block: int) -> DataFrame:
    """The cells, those with more members than a block made anew from finer sketches.

    SKETCH values tell sets that share two fifths from linked ones only by their numbers, so a
    passage of that length makes one cell of all texts that have it. By FINE values the least
    overlap is nearly the threshold (just that for sets which are whole in such a sketch), and
    such texts have no key in common. What is linked stays together, as a pair of a large
    cell is among the sets that are divided. Texts are sketched where they are.
    """
    members = materialize(members)
    large = materialize(members.groupBy("leader").agg(F.count("*").alias("c")).where(F.col("c") > block))
    if large.isEmpty():
        return members
    many = materialize(joined_by_count(members.select("leader", "rep"), large, "leader", "c").select("rep").distinct())
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    texts = filtered(ids, "rep", id_filter(many, "rep"), inside=True)
    fine = sketches(texts, "rep", "text", shingle, FINE).where("n_shingles > 0").withColumnRenamed("doc_id", "rep")
    fine = materialize(fine.join(many.hint("merge"), "rep", "left_semi").dropDuplicates(["rep", "set_key"]))
    rest = members.join(F.broadcast(large.select("leader")), "leader", "left_anti")  # a large cell has more than a block of all members
    return rest.unionByName(cells(fine, threshold, FINE))


_NO_VALUE = np.iinfo(np.int64).max


def estimated(sketches: np.ndarray, n: np.ndarray, i: int, rows: np.ndarray) -> np.ndarray:
    """Jaccard similarity of set i with those in rows by the sketch of their union; exact where both sets are whole in their sketches.

    Row i of `sketches` has the smallest values of a set of n[i], filled up with _NO_VALUE.
    """
    k = sketches.shape[1]
    mine, theirs = sketches[i], sketches[rows]
    # the k smallest of the union end at the k-th smallest of both; shared values up to there estimate the similarity
    at = np.searchsorted(mine, theirs)
    same = (at < k) & (mine[np.minimum(at, k - 1)] == theirs) & (theirs < _NO_VALUE)
    before = np.arange(k) + 1 + at + same - np.cumsum(same, axis=1)  # rank in the union
    both = same.sum(axis=1)
    whole = (n[i] <= k) & (n[rows] <= k)
    return np.where(whole, both / np.maximum(n[i] + n[rows] - both, 1), (same & (before <= k)).sum(axis=1) / k)


def _screened(threshold: float):
    """The members of a cell that may be linked to another one there. Cells of several blocks pass whole, as their blocks meet later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["leader", "block"]):
            m, n = t.num_rows, t["n"].to_numpy()
            keep = np.full(m, t["blocks"][0].as_py() > 1)
            if not keep.any():
                sketches = _matrix(t["sketch"])
                for i in range(m - 1):
                    hit = _may_link(sketches, n, i, np.arange(i + 1, m), threshold)
                    keep[hit] = True
                    keep[i] |= len(hit) > 0
            if keep.any():
                yield from t.select(["leader", "block", "rep", "blocks"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


class _Sets:
    """The shingle sets of some texts, side by side, with their sketches."""

    def __init__(self, texts: list[str | None], shingle: int, k: int):
        parts = [shingle_set(t, shingle) for t in texts]
        self.n = np.array([len(p) for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.flat = np.concatenate(parts)
        self.sketch = np.full((len(parts), k), _NO_VALUE)
        for row, p in zip(self.sketch, parts, strict=True):
            row[: min(k, len(p))] = p[:k]
        self.k = k

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def similar(self, i: int, rows: np.ndarray, least: float) -> np.ndarray:
        """Jaccard similarity of set i with those in rows; 0 where the union sketch puts it below `least`."""
        one, out = self.of(i), np.zeros(len(rows))
        if not len(one) or not len(rows):
            return out
        slot = np.arange(len(rows))
        if least > 0:
            may = estimated(self.sketch, self.n, i, rows)
            slot = np.flatnonzero((may >= least) | ((self.n[rows] <= self.k) & (self.n[i] <= self.k)))
        near = rows[slot]
        if not len(near):
            return out
        n = self.n[near]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(self.starts[near] - (ends - n), n)
        x = self.flat[index]
        at = np.searchsorted(one, x)
        hit = one[np.minimum(at, len(one) - 1)] == x
        common = np.add.reduceat(hit, ends - n) if len(n) else np.empty(0)
        common = np.where(n > 0, common, 0)
        out[slot] = common / (len(one) + n - common)
        return out


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _linked(common_similarity: np.ndarray, threshold: float) -> np.ndarray:
    return common_similarity >= threshold - 1e-12


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    A-Z count as a-z; words are runs of characters other than space and 0x09 to 0x0D; a
    document's set holds its distinct shingles of `shingle` words, all its words as one if it
    has fewer. Null and empty texts and texts without words have an empty set, link with
    nothing and are their own component. Documents link when the Jaccard similarity of their
    full sets is at least `threshold`; component_id is the smallest id reachable. Equal sets
    are compared once. Rows that repeat an id count as one document that has all their
    links; a null id is kept and links with nothing. Only id and text are read, so other
    columns may have any names. Texts are read whole; an empty table gives an empty result.

    Sets have 64-bit hashes of words for members. A pair with similarity of just `threshold`
    is missed as a candidate with a probability of some millionths (`loose`); any candidate is
    decided on full sets.
    """
    sketched = materialize(sketches(docs, id_col, text_col, shingle))
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    # written once: every step over the sketches would shuffle them again
    sets = materialize(usable.join(reps.hint("merge"), "set_key").where("doc_id = rep").select("rep", "set_key", "n_shingles", "sketch").dropDuplicates(["set_key"]))
    members = materialize(_divided(cells(sets, threshold), docs, id_col, text_col, shingle, threshold, block).withColumn("of", F.xxhash64("rep")))
    # a block has about `block` texts, or fewer that are long
    sizes = members.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.count("*").alias("c"))
    placed = materialize(
        joined_by_count(members, sizes, "leader", "c", prune=False).select("leader", "rep", "blocks", F.pmod("of", "blocks").alias("block"))
    )
    # the leader of a cell of several blocks goes to each of them
    spread = placed.where("leader <> rep").unionByName(
        placed.where("leader = rep").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    # sketches first: texts are fetched only for members that some other one of their cell may be linked to
    known = filtered(sets.select("rep", F.col("n_shingles").alias("n"), "sketch"), "rep", id_filter(placed, "rep"), inside=True)
    hopeful = materialize(
        spread.join(known.hint("merge"), "rep")
        .select("leader", "block", "rep", "blocks", "n", "sketch")
        .repartition("leader", "block")
        .sortWithinPartitions("leader", "block", "rep")
        .mapInArrow(_screened(threshold), "leader long, block long, rep long, blocks long")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    wanted = filtered(texts, "rep", id_filter(hopeful, "rep"), inside=True)
    found = materialize(
        hopeful.join(wanted.hint("merge"), "rep")
        .select("leader", "block", "rep", "blocks", "text")
        .repartition("leader", "block")
        .sortWithinPartitions("leader", "block", "rep")
        .mapInArrow(_within(shingle, threshold), _FOUND)
    )
    links = found.where("kind = 'link'").select("a", "b")
    far = found.where("kind = 'far'")
    if not far.isEmpty():
        links = links.unionByName(_across(found, far, known, texts, shingle, threshold))
    components = connected_components(links)
    labels = reps.join(components.hint("merge"), F.col("rep") == F.col("node"), "left").select(
        F.col("set_key"), F.coalesce("component", "rep").alias("component_id")
    )
    return sketched.drop("sketch").join(labels.hint("merge"), "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def _within(shingle: int, threshold: float):
    """Links in each block of a cell: the leader with all, then those it leaves with the others.

    Where a cell has more blocks, a row for each member gives its distance to the leader:
    'near' if it's in the leader's group, 'far' if not.
    """
    least = loose(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["leader", "block"]):
            leader, block_no, blocks = t["leader"][0].as_py(), t["block"][0].as_py(), t["blocks"][0].as_py()
            ids = t["rep"].to_numpy()
            sets = _Sets(t["text"].to_pylist(), shingle, SKETCH)
            up, links = list(range(len(ids))), []
            rows = np.arange(len(ids))
            first = int(np.flatnonzero(ids == leader)[0]) if (ids == leader).any() else -1  # a leader that nothing may be linked to isn't there
            full = sets.similar(first, rows, -1.0) if first >= 0 else np.zeros(len(ids))
            full[ids == leader] = 1.0

            def join(i: int, hits: np.ndarray, up: list[int] = up, links: list = links, ids: np.ndarray = ids) -> None:
                for j in hits:
                    x, y = _root(up, i), _root(up, int(j))
                    if x != y:
                        up[x] = y
                        links.append((ids[i], ids[j]))

            if first >= 0:
                join(first, np.flatnonzero(_linked(full, threshold)))
            distance = 1 - full
            for i in rows:
                if first >= 0 and _root(up, int(i)) == _root(up, first):
                    continue
                # Jaccard distance is a metric: pairs whose distances to the leader differ by more than the limit can't link
                others = rows[np.abs(distance - distance[i]) <= 1 - threshold + 1e-9]
                others = others[others != i]
                join(int(i), others[_linked(sets.similar(int(i), others, least), threshold)])
            out = [("link", leader, block_no, int(a), int(b), 0.0) for a, b in links]
            if blocks > 1:
                root = _root(up, first)
                out += [
                    ("near" if _root(up, int(i)) == root else "far", leader, block_no, int(ids[i]), blocks, float(distance[i]))
                    for i in rows
                    if ids[i] != leader or block_no == 0
                ]
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "leader", "block", "a", "b", "distance"]
    )


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows of SKETCH values, filled up with _NO_VALUE."""
    lists = lists.combine_chunks()
    out = np.full((len(lists), SKETCH), _NO_VALUE)
    out[np.arange(SKETCH) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    return out


def _may_link(sketches: np.ndarray, n: np.ndarray, i: int, rows: np.ndarray, threshold: float) -> np.ndarray:
    """Those of rows whose sets may be linked to set i."""
    exact = (n[i] <= SKETCH) & (n[rows] <= SKETCH)
    return rows[estimated(sketches, n, i, rows) >= np.where(exact, threshold - 1e-12, loose(threshold))]


def _across(found: DataFrame, far: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links between blocks of large cells: chunks of what is far from the leader against each other block, by sketches first, then by texts."""
    # chunks are as large as the blocks of their cell
    is_far = F.count_if(F.col("kind") == "far")
    chunks = found.where("kind <> 'link'").groupBy("leader").agg(F.ceil(is_far / (F.count("*") / F.max("b"))).cast("long").alias("chunks")).where("chunks > 0")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (
        far.join(chunks, "leader")
        .withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")))
        .withColumn("of", upto("b"))
        .where("of <> block")
        .select("leader", F.col("of").alias("block"), "chunk", F.lit(1).alias("far"), F.col("a").alias("rep"), "distance")
    )
    right = (
        found.where("kind <> 'link'")
        .join(chunks, "leader")
        .withColumn("chunk", upto("chunks"))
        .select("leader", "block", "chunk", F.lit(0).alias("far"), F.col("a").alias("rep"), "distance")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["leader", "block", "chunk"]):
            is_far = t["far"].to_numpy() == 1
            if is_far.all() or not is_far.any():
                continue
            ids, distance = t["rep"].to_numpy(), t["distance"].to_numpy()
            sets = _Sets(t["text"].to_pylist(), shingle, SKETCH)
            up, out = list(range(len(ids))), []
            there = np.flatnonzero(~is_far)
            for i in np.flatnonzero(is_far):
                rows = there[np.abs(distance[there] - distance[i]) <= 1 - threshold + 1e-9]
                for j in rows[_linked(sets.similar(int(i), rows, loose(threshold)), threshold)]:
                    x, y = _root(up, int(i)), _root(up, int(j))
                    if x != y:
                        up[x] = y
                        out.append(("link", int(t["leader"][0].as_py()), 0, int(ids[i]), int(ids[j]), 0.0))
            if out:
                yield _rows(out)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["leader", "block", "chunk"]):
            is_far, distance, n = t["far"].to_numpy() == 1, t["distance"].to_numpy(), t["n"].to_numpy()
            sketches, keep, there = _matrix(t["sketch"]), np.zeros(t.num_rows, dtype=bool), np.flatnonzero(~is_far)
            for i in np.flatnonzero(is_far):
                hit = _may_link(sketches, n, int(i), there[np.abs(distance[there] - distance[i]) <= 1 - threshold + 1e-9], threshold)
                keep[hit] = True
                keep[i] = len(hit) > 0
            if keep.any():
                yield from t.select(["leader", "block", "chunk", "far", "rep", "distance"]).filter(pa.array(keep)).combine_chunks().to_batches()

    asked = materialize(
        left.unionByName(right).join(known.hint("merge"), "rep")
        .select("leader", "block", "chunk", "far", "rep", "distance", "n", "sketch")
        .repartition("leader", "block", "chunk")
        .sortWithinPartitions("leader", "block", "chunk")
        .mapInArrow(screen, "leader long, block long, chunk long, far int, rep long, distance double")
    )
    wanted = filtered(texts, "rep", id_filter(asked, "rep"), inside=True)
    return (
        asked.join(wanted.hint("merge"), "rep")
        .select("leader", "block", "chunk", "far", "rep", "distance", "text")
        .repartition("leader", "block", "chunk")
        .sortWithinPartitions("leader", "block", "chunk")
        .mapInArrow(run, _FOUND)
        .select("a", "b")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The input without documents that a smaller id of their group stands for; all its columns stay.

    Rows that repeat an id with other texts are documents of their own here, which come after
    all others: such a row goes only if its own text has a copy that stays. Rows that repeat id
    and text stay or go together, and null ids stay.
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    repeated = materialize(docs.select(key.alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(id_col))
        return without_ids(docs, id_col, gone)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("doc_id"), text.alias("text"))
    words, last = id_filter(repeated, "doc_id"), rows.agg(F.max("doc_id")).first()[0]
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    doubtful = filtered(rows, "doc_id", words, inside=True).withColumn("digest", digest)
    own = doubtful.join(repeated.select("doc_id").hint("merge"), "doc_id").select("doc_id", "digest").distinct()
    own = materialize(own.withColumn("rid", F.lit(last + 1) + F.monotonically_increasing_id()))
    marked = doubtful.join(own.hint("merge"), ["doc_id", "digest"], "left").select("row", F.coalesce("rid", "doc_id").alias("rid"), "text")
    every = filtered(rows, "doc_id", words, inside=False).select("row", F.col("doc_id").alias("rid"), "text").unionByName(marked)
    gone = near_duplicates(every, "rid", "text", **options).where("not kept").select(F.col("doc_id").alias("rid"))
    return without_ids(every, "rid", gone).select("row.*")
