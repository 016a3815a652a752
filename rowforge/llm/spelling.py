"""Spelling variants: a minimised acceptor of the vocabulary, a one-edit transducer and the acceptor again, composed per initial state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import materialize, mix64, runs

#: Words of one acceptor, at most; initial states with more are followed to longer prefixes.
BLOCK = 20_000
#: Prefix lengths at which the vocabulary is divided. Longer words than the last are divided at every letter.
DEPTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: One deletion in so many runs, as the query's contract asks.
NOISE = 31
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PAIRS = "a string, b string"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 7, seen: int = 2, noise: int | None = NOISE) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with at least `least` code points and `seen` occurrences.

    Where `noise` divides the CRC-32 of `<id>:<run>`, the code point at that number modulo the
    run's length is deleted first; with a null id, or noise None, none is. Null texts have no words.
    """
    runs_of = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), F.lit(0))
    words = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(runs_of).alias("run"))
    words = words.where(F.length("run") >= least).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    word: Column = F.col("run")
    if noise:
        h, size = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.length("run")
        at = (h % size).cast("int")
        cut = F.concat(F.left("run", at), F.substr("run", at + 2))
        word = F.when((h % noise == 0) & F.col("id").isNotNull(), cut).otherwise(word)
    words = words.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.length("word") >= least) & (F.col("n") >= seen))


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words: equal right languages are one state.

    `arcs[s]` maps a letter to the next state, in order of letters; `final[s]` says whether a word may end in s.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def state(final: bool, arcs: dict[str, int]) -> int:
            key = (final, tuple(arcs.items()))
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return at

        # the path of the word before: (letter that leads here, final, arcs of states that are settled)
        path: list[list] = [["", False, {}]]

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                letter, final, arcs = path.pop()
                path[-1][2][letter] = state(final, arcs)

        before = ""
        for w in words:
            same = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                same += 1
            settle(same)
            path += [[c, False, {}] for c in w[same:]]
            path[-1][1] = True
            before = w
        settle(0)
        self.root = state(path[0][1], path[0][2])


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of sorted distinct words that a single inserted, deleted or replaced letter parts, each once.

    The composition acceptor * one-edit transducer * acceptor, walked state by state. Before the
    edit both acceptors are in one state; the edit is taken at the first letter that differs;
    after it both read the same letters, in the product of two states, and what can't end there is
    remembered. Nothing recurs, so words may be long.
    """
    a = Acceptor(words)
    arcs, final = a.arcs, a.final
    ends: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """Letters by which states p and q have a common rest; '' if both may end here."""
        todo = [(p, q)]
        while todo:
            u, v = key = todo[-1]
            if key in ends:
                todo.pop()
                continue
            x, y = arcs[u], arcs[v]
            if len(x) > len(y):
                x, y = y, x
            both = [c for c in x if c in y]
            if u == v:
                ends[key] = ([""] if final[u] else []) + both
                continue
            missing = [k for c in both if (k := _ordered(arcs[u][c], arcs[v][c])) not in ends]
            if missing:
                todo += missing
                continue
            ends[key] = ([""] if final[u] and final[v] else []) + [c for c in both if ends[_ordered(arcs[u][c], arcs[v][c])]]
            todo.pop()
        return ends[(p, q)]

    def rests(p: int, q: int) -> Iterator[str]:
        """All common rests of two states."""
        todo = [(*_ordered(p, q), "")]
        while todo:
            u, v, rest = todo.pop()
            for c in common(u, v):
                if c:
                    todo.append((*_ordered(arcs[u][c], arcs[v][c]), rest + c))
                else:
                    yield rest

    todo = [(a.root, "")]
    while todo:
        s, prefix = todo.pop()
        out = list(arcs[s].items())
        for i, (c, p) in enumerate(out):
            todo.append((p, prefix + c))
            for d, q in out[i + 1 :]:  # replaced: both go on by different letters
                if common(*_ordered(p, q)):
                    for rest in rests(p, q):
                        yield prefix + c + rest, prefix + d + rest
            # deleted: one reads c, the other none; its next letter isn't c, or the edit could stand later
            if common(*_ordered(p, s)):
                for rest in rests(p, s):
                    if not rest.startswith(c):
                        yield prefix + c + rest, prefix + rest


def _ordered(p: int, q: int) -> tuple[int, int]:
    return (p, q) if p <= q else (q, p)


def _divided(words: DataFrame, block: int) -> DataFrame:
    """(word, cut): the length of each word's initial prefix. A prefix of that length has at most `block` words.

    Words that are no longer than a prefix which is still common, and those longer than the last
    of DEPTHS, are cut at their end.
    """
    length = F.length("word")
    done = None
    left = words.select("word").where(length <= DEPTHS[-1])
    ended = words.select("word").where(length > DEPTHS[-1]).withColumn("cut", F.length("word"))
    for k, depth in enumerate(DEPTHS):
        prefix = F.left(F.col("word"), F.lit(depth))
        keyed = left.withColumn("__p", prefix)
        large = materialize(keyed.groupBy("__p").agg(F.count("*").alias("m")).where(F.col("m") > block).select("__p").repartition(1))
        if k + 1 == len(DEPTHS) or large.isEmpty():
            now = left.withColumn("cut", F.least(F.lit(depth), length))
            return ended.unionByName(now if done is None else done.unionByName(now))
        # a common prefix has more than `block` words, so there's at most one for so many words
        fine = keyed.join(F.broadcast(large), "__p", "left_anti").select("word", F.least(F.lit(depth), length).alias("cut"))
        over = materialize(keyed.join(F.broadcast(large), "__p", "left_semi").select("word"))
        short = over.where(length <= depth).withColumn("cut", length)
        done = fine.unionByName(short) if done is None else done.unionByName(fine).unionByName(short)
        left = over.where(length > depth)
    raise AssertionError


_CODES = np.uint64(0x9E3779B97F4A7C15)
_WEIGHT = np.uint64(0xD6E8FEB86659FD93)


def _residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, id): each word (at -1), and what is left of it without its letter `at`, for every place before its cut.

    Keys are 64-bit hashes of letters by their places, so one costs a step, however long the
    word, and rows carry the word's id only; what meets is compared letter by letter later.
    """
    for b in batches:
        if not b.num_rows:
            continue
        ids, words, cut = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy().astype(np.int64)
        x = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        x = mix64(x * _CODES + np.uint64(1))
        ends = np.cumsum([len(w) for w in words])
        starts = ends - np.diff(ends, prepend=0)
        place = (np.arange(len(x)) - np.repeat(starts, ends - starts)).astype(np.uint64)
        # sums of letters where they stand, and of letters one place to the left, as they come after the gap
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(x + (place - np.uint64(k)) * _WEIGHT), dtype=np.uint64)]) for k in (0, 1)]
        # a row for the whole word, then one for each place before its cut
        per = np.cumsum(cut + 1)
        for low in range(0, int(per[-1]), 100_000):
            row = np.arange(low, min(low + 100_000, int(per[-1])))
            i = np.searchsorted(per, row, side="right")
            at = row - (per[i] - cut[i] - 1) - 1
            gap = np.where(at < 0, ends[i] - starts[i], at)
            key = sums[0][starts[i] + gap] - sums[0][starts[i]] + np.where(at < 0, np.uint64(0), sums[1][ends[i]] - sums[1][np.minimum(starts[i] + gap + 1, ends[i])])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at, pa.int32()), pa.array(ids[i])], ["key", "at", "id"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, at, cut): ids of words with the same rest, from rows sorted by key; `cut` says whether b, too, is without a letter.

    A rest that comes of several letters of a word stands for the last of them: up to there both words are the same.
    """
    for t in runs(batches, ["key"]):
        if t.num_rows < 2:
            continue
        last: dict[int, int] = {}
        whole, by_place = [], {}
        for k, i in zip(t["at"].to_pylist(), t["id"].to_pylist(), strict=True):
            if k < 0:
                whole.append(i)
            else:
                last[i] = max(k, last.get(i, 0))
                by_place.setdefault(k, []).append(i)
        pairs = [(i, j, k, False) for j in whole for i, k in last.items()]
        pairs += [(i, j, k, True) for k, some in by_place.items() for n, i in enumerate(some) for j in some[n + 1 :]]
        if pairs:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), kinds, strict=True)], ["a", "b", "at", "cut"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each initial state, from rows sorted by state and word."""
    for t in runs(batches, ["state"]):
        by_prefix: dict[str, list[str]] = {}
        for w, cut in zip(t["word"].to_pylist(), t["cut"].to_pylist(), strict=True):
            by_prefix.setdefault(w[:cut], []).append(w[cut:])
        for prefix, rest in by_prefix.items():
            if len(rest) < 2:
                continue
            out = []
            for a, b in one_edit_pairs(sorted(rest)):
                out.append((prefix + a, prefix + b))
                if len(out) == 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)


def _batch(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(a, b): every pair of distinct words that differ by exactly one inserted, deleted or replaced code point, once each.

    Words are divided by their initial states: the state that a prefix leads to, with prefixes
    long enough that at most `block` words share one. If the first letter that differs stands
    behind the prefix, both words are in one state's task, which composes its acceptor with the
    one-edit transducer and itself. If it stands within the prefix, the edit is taken on the way
    to the initial states, and both words have the same rest: they meet by what is left of them
    without the letter at that place. A word has a row for each letter of its prefix, and no more
    words than the alphabet has letters meet at one place. Words longer than the last of DEPTHS
    are prefix altogether, so that no acceptor holds their letters.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    divided = materialize(_divided(words, block))
    inside = (
        divided.select(F.xxhash64(F.expr("left(word, cut)")).alias("state"), "word", "cut")
        .repartition(parts, "state")
        .sortWithinPartitions("state", "word")
        .mapInArrow(_composed, _PAIRS)
    )
    ids = divided.select(F.xxhash64("word").alias("id"), "word", "cut")
    met = (
        ids.mapInArrow(_residuals, "key long, at int, id long")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "at", "id")
        .mapInArrow(_meeting, "a long, b long, at int, cut boolean")
    )
    named = [ids.select(F.col("id").alias(n), F.col("word").alias(f"{n}_word")) for n in ("a", "b")]
    rest = "concat(left(a_word, at), substr(a_word, at + 2)) = if(cut, concat(left(b_word, at), substr(b_word, at + 2)), b_word)"
    before = met.join(named[0], "a").join(named[1], "b").where(f"{rest} and substr(a_word, at + 1, 1) <> substr(b_word, at + 1, 1)")
    before = before.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"))
    return inside.unionByName(before)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 7, seen: int = 2, noise: int | None = NOISE, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the vocabulary (`vocabulary`).

    Two words are near if one inserted, deleted or replaced code point parts them. A word's form
    is its near word with the largest n (ties: the smallest in code-point order) if that n is at
    least `ratio` times the word's, else null. `root` follows forms to the last; n grows by
    `ratio` with each step, so there are few steps and no circles. Texts are read whole; null and
    empty texts and those without letters have no words, rows that repeat an id are texts of
    their own, and copies count each time. Only id and text are read, so other columns may have
    any names. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent: a ratio of 2 at least")
    words = materialize(vocabulary(docs, id_col, text_col, least=least, seen=seen, noise=noise))
    # each pair both ways, in one pass
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = near_words(words, block=block).select(F.inline(ways))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the smallest word of those with the largest n: both in one struct, smallest first
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    known = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * ratio
    forms = materialize(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
        )
    )
    up = forms.where("form is not null").select("word", "form")
    step = up.withColumnRenamed("form", "root")
    # a step multiplies n by `ratio` at least, which says how many there can be
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    while seen * ratio ** (steps + 1) <= most:
        steps += 1
    for _ in range(steps - 1):
        further = up.select(F.col("word").alias("root"), F.col("form").alias("next"))
        step = step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
