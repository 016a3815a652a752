"""Language identification by interpolated Kneser-Ney character models of all grams of all languages, in tables and sorted arrays of hashes."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import materialize, mix64

ORDER = 4
#: Steps, as decimal digits, of the cross-entropies that rejection limits are quantiles of: as counts of steps they have a bound that doesn't follow the data.
STEPS = 4
#: Bytes of text, about, that meet their part of the model in one task, and the least number of such portions.
PORTION = 16 << 20
PORTIONS = 16
#: Rows of the models' tables, at most, that every task holds as sorted arrays (28 bytes each); more of them are joined to portions of text.
HELD = 2_000_000
TEMPERATURES = (1, 2, 5, 10, 20, 50)
_CHUNK = 1 << 20
_BLOCK = 1 << 18
_letter: list[np.ndarray] = []


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose CRC-32, as text, is 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def normalized(text: str) -> np.ndarray:
    """Lower-case code points with one space for each run of non-letters, two in front and one behind; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = _letters()[codes]
    if not solid.any():
        return codes[:0]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first of each run of others, as a space
    out = np.where(solid, codes, np.uint32(32))[keep]
    if out[0] == 32:
        out = out[1:]
    if out[-1] != 32:
        out = np.append(out, np.uint32(32))
    return np.concatenate([np.array([32, 32], dtype=np.uint32), out])


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    h = np.full(max(0, len(codes) - n + 1), np.uint64(n), dtype=np.uint64)
    for j in range(n):
        h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


def _joined(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind one another with a 0 between, and where an n-gram lies within one text."""
    flat = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint32))])
    zero = np.concatenate([[0], np.cumsum(flat == 0)])
    return flat, np.flatnonzero(zero[n:] == zero[:-n])


def gram_counts(docs: DataFrame, text_col: str, lang_col: str, n: int = ORDER, back: Column | None = None) -> DataFrame:
    """(lang, gram, c, rest) over all rows, pre-aggregated in each task: occurrences, and those outside the rows that `back` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        size: dict[tuple[str, bool], int] = {}

        def close(key: tuple[str, bool]) -> pa.RecordBatch | None:
            flat, at = _joined(held.pop(key), n)
            size.pop(key)
            if not len(at):
                return None
            _, first, count = np.unique(_hash(flat, n)[at], return_index=True, return_counts=True)
            grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, n)[at[first]]).view(f"<U{n}").ravel()
            lang, back = key
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.tolist()), pa.array(count), pa.array(np.zeros_like(count) if back else count)], ["lang", "gram", "c", "rest"]
            )

        for batch in batches:
            for lang, text, back in zip(*batch.columns, strict=True):
                key = lang.as_py(), back.as_py()
                held.setdefault(key, []).append(normalized(text.as_py()))
                size[key] = size.get(key, 0) + len(held[key][-1])
                full = list(held) if sum(size.values()) > 4 * _CHUNK else [key] if size[key] > _CHUNK else []
                for k in full:
                    if out := close(k):
                        yield out
        for key in list(held):
            if out := close(key):
                yield out

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.lit(False) if back is None else back).alias("back"))
    return rows.mapInArrow(run, "lang string, gram string, c long, rest long").groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum("rest").alias("rest"))


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    n = rows.shape[1]
    h = np.full(len(rows), np.uint64(n), dtype=np.uint64)
    for j in range(n):
        h = (h ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


@dataclass
class Tables:
    """The models of all languages. `grams` has a row for each language's gram (its count) and context (its total and kinds), of every order.

    The driver holds a name, a discount for each order and a rejection limit for each
    language, and `grams` while it hands out tables of at most HELD rows.
    """

    grams: DataFrame  # key long, lang int, a double, b double
    languages: list[str]
    discounts: np.ndarray  # a row for each order, from 1
    letters: int
    temperature: float = 20.0
    limits: np.ndarray | None = None


def _keys(rows: np.ndarray, n: int, context: bool) -> np.ndarray:
    """Keys of n-grams, or of their contexts (n - 1 characters), in the tables; orders and contexts never share one."""
    return mix64(_rows_hash(rows) ^ np.uint64(2 * n + context)).view(np.int64)


def _all_keys(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: keys of what highest-order grams end with, and of its context."""
    n = rows.shape[1]
    for k in range(1, n + 1):
        yield _keys(rows[:, n - k :], k, False), _keys(rows[:, n - k : n - 1], k, True)


def _codes(grams: list[str], n: int) -> np.ndarray:
    return np.array(grams, dtype=f"<U{n}").view(np.uint32).reshape(len(grams), n) if n else np.empty((len(grams), 0), np.uint32)


def model_tables(counts: DataFrame, n: int = ORDER) -> Tables | None:
    """Models from the counts (lang, gram, c) of all grams of the highest order: continuation counts below, discounts from both; None without grams."""
    orders = {n: counts.select("lang", "gram", "c")}
    for k in range(n - 1, 0, -1):
        orders[k] = materialize(orders[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    letters = orders[n].select(F.explode(F.split("gram", "")).alias("x")).where("x <> ''").distinct().count() + 1
    found: dict[str, dict[int, float]] = {}
    for k in range(1, n + 1):
        for r in orders[k].groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect():
            d = r.once / (r.once + 2 * r.twice) if r.once else 0.5
            found.setdefault(r.lang, {})[k] = min(max(d, 0.1), 0.9)
    if not found:
        return None
    languages = sorted(found)
    number = {x: j for j, x in enumerate(languages)}

    def keyed(k: int, context: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = _keys(_codes(b.column(1).to_pylist(), k - context), k, context)
                langs = pa.array([number[x] for x in b.column(0).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys), langs, b.column(2), b.column(3)], ["key", "lang", "a", "b"])

        return run

    grams = None
    for k in range(1, n + 1):
        seen = orders[k].select("lang", "gram", F.col("c").cast("double").alias("a"), F.lit(0.0).alias("b"))
        left = orders[k].groupBy("lang", F.substring("gram", 1, k - 1).alias("gram")).agg(F.sum("c").cast("double").alias("a"), F.count("*").cast("double").alias("b"))
        for part in (seen.mapInArrow(keyed(k, False), _TABLE), left.mapInArrow(keyed(k, True), _TABLE)):
            grams = part if grams is None else grams.unionByName(part)
    discounts = np.array([[found[x][k] for x in languages] for k in range(1, n + 1)])
    return Tables(materialize(grams), languages, discounts, letters)


_TABLE = "key long, lang int, a double, b double"
_SCORED = "doc_id long, held_out boolean, lang string, best int, top double, own double, shares array<double>, sums array<double>"


def _slices(texts: pa.ChunkedArray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Places and normalized forms of the texts with letters, about _CHUNK characters at a time."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        if (text := text.as_py()) is not None and len(x := normalized(text)):
            at.append(i)
            held.append(x)
            size += len(x)
            if size > _CHUNK:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def _distinct(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as rows of code points, and which of them is where, text by text."""
    flat, at = _joined(texts, n)
    _, first, which = np.unique(_hash(flat, n)[at], return_index=True, return_inverse=True)
    return np.lib.stride_tricks.sliding_window_view(flat, n)[at[first]], which


def scored(rows: DataFrame, model: Tables, temperatures: tuple[float, ...]) -> DataFrame:
    """Of (doc_id, held_out, lang, text): the best language and its score, and for each temperature the sum of exp(t * (score - top)).

    A score is the mean natural log probability of a character. Texts without letters have none.
    Rows with a `lang` must be rows that the counts have under it: `own` is the score of `lang` by
    counts without this text (`_left_out`), `shares` its share among the languages at each
    temperature. Both are null for other rows, and where nothing else is in that language.
    Tables of at most HELD rows, by count, are sorted arrays in every task, and texts stay where they
    are. Of larger ones each portion of the texts gets what it needs by a join (`_met`). Both
    give the same scores from all grams.
    """
    if model.grams.limit(HELD + 1).count() > HELD:
        return _met(rows, model, temperatures)
    t = model.grams.orderBy("lang", "key").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast([t.column(c).to_numpy() for c in ("key", "lang", "a", "b")])
    score = _scorer(model, temperatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                yield from score(pa.Table.from_batches([batch.slice(k, 1000)]), *shared.value).to_batches()

    return rows.select("doc_id", "held_out", "lang", "text").mapInArrow(run, _SCORED)


def _scorer(model: Tables, temperatures: tuple[float, ...]):
    """A function from texts and rows of the model's tables, sorted by language and key, to rows of _SCORED."""
    languages, discounts, letters = model.languages, model.discounts, model.letters
    n = len(discounts)

    def score(docs: pa.Table, key: np.ndarray, lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
        ends = np.searchsorted(lang, np.arange(len(languages) + 1))
        truth = np.array([bisect.bisect_left(languages, x) if x is not None else -1 for x in docs.column("lang").to_pylist()], dtype=np.int64)
        count, t = docs.num_rows, np.array(temperatures, dtype=float)
        best, top, own, sums = np.full(count, -1), np.full(count, -np.inf), np.full(count, np.nan), np.zeros((count, len(t)))
        other, rest = np.full(count, -np.inf), np.zeros((count, len(t)))  # of the languages other than `lang`: the highest score and the sums
        for at, texts in _slices(docs.column("text")):
            at = np.array(at)
            unique, which = _distinct(texts, n)
            keys = list(_all_keys(unique))
            lengths = np.array([len(x) - n + 1 for x in texts])
            starts = np.cumsum(lengths) - lengths
            known = truth[at]
            ids = [[np.unique(x, return_inverse=True)[1] for x in pair] for pair in keys] if (known >= 0).any() else []
            for j in range(len(languages)):
                mine, values, kinds = (x[ends[j] : ends[j + 1]] for x in (key, a, b))
                p, orders, its = np.full(len(unique), 1.0 / letters), [], np.flatnonzero(known == j)
                for d, (gram, context) in zip(discounts[:, j], keys, strict=True):
                    seen, place = _places(mine, context)
                    total = values[place]
                    p[seen] *= d * kinds[place] / total
                    whole, sorts, times = (np.zeros(len(unique)) for _ in range(3))
                    whole[seen], sorts[seen] = total, kinds[place]
                    seen, place = _places(mine, gram)
                    p[seen] += (values[place] - d) / whole[seen]
                    times[seen] = values[place]
                    orders.append((d, times, whole, sorts))
                s = np.add.reduceat(np.log(p)[which], starts) / lengths
                if len(its):
                    own[at[its]] = _left_out(orders, ids, which, starts[its], lengths[its], letters)
                out = known != j
                new, old, now = np.maximum(other[at], s)[out], other[at][out], at[out]
                rest[now] = rest[now] * np.exp(t * (old - new)[:, None]) + np.exp(t * (s[out] - new)[:, None])
                other[now] = new
                new = np.maximum(top[at], s)
                sums[at] = sums[at] * np.exp(t * (top[at] - new)[:, None]) + np.exp(t * (s - new)[:, None])
                best[at] = np.where(s > top[at], j, best[at])
                top[at] = new
        none, unknown = best < 0, np.isnan(own)
        high = np.where(unknown, 0.0, np.maximum(own, other))
        mine = np.exp(t * (np.where(unknown, 0.0, own) - high)[:, None])
        shares = mine / (mine + rest * np.exp(t * np.minimum(other - high, 0.0)[:, None]))
        listed = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(t), dtype=np.int32), x.ravel())
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "lang": docs.column("lang"), "best": pa.array(best, pa.int32(), mask=none),
            "top": pa.array(top, mask=none), "own": pa.array(own, mask=unknown), "shares": listed(shares), "sums": listed(sums),
        })

    return score


def _left_out(orders: list, ids: list, which: np.ndarray, starts: np.ndarray, lengths: np.ndarray, letters: int) -> np.ndarray:
    """Scores of texts of one language by its counts without each text itself; discounts and letters stay. NaN where no other text is left.

    `orders`: for each order its discount and, for each distinct gram, the count of what it ends
    with, and total and kinds of that one's context; `ids`: numbers of these endings and contexts.
    A gram that occurs in this text alone goes, and with it one from the count below.
    """
    out, size = np.full(len(starts), np.nan), len(orders[0][1])
    ends = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _BLOCK, "right")))
        n = lengths[first:last]
        doc = np.repeat(np.arange(last - first), n)
        place = np.arange(len(doc)) + np.repeat(starts[first:last] - (np.cumsum(n) - n), n)
        pair, less = np.unique(doc * size + which[place], return_counts=True)
        of, gram = np.divmod(pair, size)
        doc, times, up, parts = of, less, None, []
        for (d, count, total, kinds), (ending, context) in zip(reversed(orders), reversed(ids), strict=True):
            if parts:  # endings, one order lower, of what this text has
                _, at, up = np.unique(doc * size + ending[gram], return_index=True, return_inverse=True)
                doc, gram, less = doc[at], gram[at], np.bincount(up, gone)
            left = count[gram] - less
            gone = left < 0.5
            _, met = np.unique(doc * size + context[gram], return_inverse=True)
            whole, sorts = total[gram] - np.bincount(met, less)[met], kinds[gram] - np.bincount(met, gone)[met]
            parts.append((d, up, left, whole, sorts))
        p = 1.0 / letters
        for d, up, left, whole, sorts in reversed(parts):
            some = whole > 0.5
            safe = np.where(some, whole, 1.0)
            p = np.where(some, d * sorts / safe, 1.0) * p + np.where(some & (left > 0.5), (left - d) / safe, 0.0)
            p = p if up is None else p[up]
        bare = np.bincount(doc, parts[-1][3] < 0.5, last - first) > 0  # single characters have one context, the empty one
        out[first:last] = np.where(bare, np.nan, np.bincount(of, np.log(p) * times, last - first) / n)
        first = last
    return out


def _met(rows: DataFrame, model: Tables, temperatures: tuple[float, ...]) -> DataFrame:
    """`scored` for tables of any size: portions of about PORTION bytes of text, dealt by a hash, get by a join those rows whose grams and contexts occur in them."""
    n = len(model.discounts)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    portions = max(PORTIONS, -(-size // PORTION))
    parts = max(portions, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(portions)).cast("int").alias("portion"), "doc_id", "held_out", "lang", "text").repartition(parts, "portion")
    score = _scorer(model, temperatures)

    def wanted(docs: pa.Table) -> pa.Table:
        keys = np.empty(0, np.int64)
        for _, texts in _slices(docs.column("text")):
            keys = np.unique(np.concatenate([keys, *(x for pair in _all_keys(_distinct(texts, n)[0]) for x in pair)]))
        return pa.table({"portion": pa.array(np.full(len(keys), docs.column("portion")[0].as_py(), dtype=np.int32)), "key": keys})

    def both(docs: pa.Table, grams: pa.Table) -> pa.Table:
        key, lang, a, b = (grams.column(c).to_numpy() for c in ("key", "lang", "a", "b"))
        order = np.lexsort((key, lang))
        return score(docs, key[order], lang[order], a[order], b[order])

    # both groupings read the same exchange: texts are shuffled once
    part = dealt.groupBy("portion").applyInArrow(wanted, "portion int, key long").join(model.grams, "key").select("portion", "key", "lang", "a", "b")
    return dealt.groupBy("portion").cogroup(part.groupBy("portion")).applyInArrow(both, _SCORED)


def _places(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted array, and where."""
    if not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    seen = np.flatnonzero(held[place] == wanted)
    return seen, place[seen]


def _counted(docs: DataFrame, text_col: str, lang_col: str) -> Tables | None:
    """Models of all counts, with no text rejected."""
    model = model_tables(materialize(gram_counts(docs, text_col, lang_col)))
    if model is not None:
        model.limits = np.full(len(model.languages), np.inf)
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tables | None:
    """Models of all languages of the rows with text and language, from all their grams; None where there are none.

    Temperature and rejection limits come from all these rows too, each scored by counts
    without itself; only losses and quantiles reach the driver.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    model = _counted(usable, text_col, lang_col)
    if model is not None:
        rows = usable.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        _calibrate(model, materialize(scored(rows, model, TEMPERATURES)))
    return model


def _calibrate(model: Tables, found: DataFrame) -> None:
    """Sets the temperature with the least loss on the rows scored without themselves, and for each language with 20 of them the cross-entropy beyond which a text is rejected."""
    found = found.where("own is not null")
    losses = found.agg(*(F.avg(-F.log(F.greatest(F.col("shares")[i], F.lit(1e-9)))).alias(str(t)) for i, t in enumerate(TEMPERATURES))).first()
    if losses[0] is None:
        return
    model.temperature = float(min(zip(losses, TEMPERATURES, strict=True))[1])
    spread = found.groupBy("lang").agg(F.count("*").alias("n"), F.stddev_pop("own").alias("s")).where("n >= 20")
    steps = found.groupBy("lang", F.round(-F.col("own"), STEPS).alias("x")).agg(F.count("*").alias("k"))
    limits = steps.groupBy("lang").agg(F.percentile("x", F.lit(0.99), F.col("k")).alias("q")).join(spread, "lang")
    for r in limits.collect():
        model.limits[model.languages.index(r.lang)] = r.q + 3 * r.s


def predict(docs: DataFrame, model: Tables | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per input row; only the text is scored, and all of it.

    lang_pred is the language with the lowest cross-entropy per character, `und` with score 0
    for null texts, texts without letters or no model. score is its share among the
    languages at the fitted temperature. rejected: the cross-entropy is beyond what training
    texts of that language have, so the text may be in none of them.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.lit(None).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return _judged(scored(rows, model, (model.temperature,)), model, 0)


def _judged(found: DataFrame, model: Tables, i: int) -> DataFrame:
    """Predictions of scored rows, by the temperature numbered i among those they are scored at."""
    names, limits = model.languages, model.limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, top = b.column(2).to_pylist(), b.column(3).to_pylist()
            pred = pa.array(["und" if j is None else names[j] for j in best], pa.string())
            rejected = pa.array([j is None or -x > limits[j] for j, x in zip(best, top, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pred, b.column(4), rejected], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    out = found.select("doc_id", "held_out", "best", "top", F.when(F.col("best").isNull(), 0.0).otherwise(1 / F.col("sums")[i]).alias("score"))
    return out.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that aren't held out, predict all, one row per input row (see `fit` and `predict`); one pass over the texts scores them for both.

    A null id is neither held out nor learnt from; rows without text or language aren't
    learnt from. Repeated rows count and are predicted each. An empty table gives an empty
    result, one without languages `und` everywhere. A language with fewer than 20 rows to
    calibrate on has no limit, so no text is rejected for it. Texts are read whole: a task's memory
    grows with its longest text. Only the three columns are read, whatever others are named.
    """
    learnt = F.col(id_col).isNotNull() & ~held_out(id_col)
    model = _counted(docs.where(learnt), text_col, lang_col)
    if model is None:
        return predict(docs, None, id_col=id_col, text_col=text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.when(learnt, F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")
    )
    found = materialize(scored(rows, model, TEMPERATURES))
    _calibrate(model, found)
    return _judged(found, model, TEMPERATURES.index(model.temperature))
