"""Personal data: patterns, and terms whose corpus co-occurrence discloses what the patterns protect."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import filtered, id_filter, joined_by_count, materialize

#: Kinds in the order in which spans that start together are listed. Terms are generalised, secrets removed.
KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: Documents, at least, that have both a protected value and a term, for an estimate of what the term discloses.
SUPPORT = 3
#: Share of a value's information from which a term is generalised, and from which it's removed.
THRESHOLD = 0.8
REMOVE = 0.95
_BITS = 1 << 23  # of the filter of terms that are counted: 1 MB, whatever the corpus

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping, found from each @ outwards, so that long words cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind as its place in KINDS. A match that fails its check is dropped, not tried again."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_KEYS_HELD = 300_000
_keys: dict[str, int] = {}


def word_key(word: str) -> int:
    """A 64-bit hash of a word, whatever its case; a worker keeps some that it has met."""
    k = _keys.get(word)
    if k is None:
        if len(_keys) >= _KEYS_HELD:
            _keys.clear()
        k = _keys[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) - (1 << 63)
    return k


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Words (letters, digits, underscores) that no span overlaps; spans by start."""
    at, upto = 0, 0
    for m in _WORD.finditer(text):
        u, v = m.span()
        while at < len(spans) and spans[at][0] < v:
            upto = max(upto, spans[at][2])
            at += 1
        if u >= upto:
            yield m


def word_keys(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    if spans:
        return {word_key(m.group()) for m in free_words(text, spans)}
    return set(map(word_key, set(_WORD.findall(text))))


def own_words(value: str) -> list[str]:
    """Words of three letters or more in the part of an address before the @."""
    return [w for w in re.findall(r"[^\W\d_]+", value.partition("@")[0]) if len(w) > 2]


_FOUND = (
    "row long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, values array<long>, words array<long>,"
    " own array<struct<value:long,term:long>>, terms array<struct<term:long,df:long>>"
)
_NAMES = [c.split()[0] for c in _FOUND.split(", ")[:8]] + ["values", "words", "own", "terms"]
_PAIR = pa.list_(pa.struct([("value", pa.int64()), ("term", pa.int64())]))
_DF = pa.list_(pa.struct([("term", pa.int64()), ("df", pa.int64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every whole text, and what the corpus counts need, in one pass.

    A row for each document has the hashes of its protected values and, if it has such, of its
    other words. Rows without text_key have `terms`: in how many documents of a task's
    portion each word stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        seen: list[np.ndarray] = []

        def portion() -> pa.RecordBatch:
            term, df = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            lists = pa.ListArray.from_arrays(pa.array([0, len(term)], pa.int32()), pa.StructArray.from_arrays([pa.array(term), pa.array(df)], ["term", "df"]))
            kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), _PAIR]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), lists.cast(_DF)], names=_NAMES)

        for batch in batches:
            counts, base, values, words, own = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                keys = word_keys(text, spans)
                seen.append(np.fromiter(keys, np.int64, len(keys)))
                counts.append([sum(k == j for _, k, _ in spans) for j in range(4)])
                base.append(joined(spans))
                named = {f"{KINDS[k]}:{text[s:e]}": k for s, k, e in spans}
                values.append(list({word_key(x) for x in named}))
                words.append(list(keys) if spans else [])
                pairs = {(word_key(x), word_key(w)) for x, k in named.items() if k == 0 for w in own_words(x[6:])}
                own.append([{"value": v, "term": w} for v, w in pairs if w in keys])
            c = np.array(counts, dtype=np.int64).reshape(-1, 4)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(base))), batch.column(0), batch.column(1), *(pa.array(c[:, j]) for j in range(4)), pa.array(base, pa.string()),
                    pa.array(values, longs), pa.array(words, longs), pa.array(own, _PAIR), pa.nulls(len(base), _DF),
                ],
                names=_NAMES,
            )
            row += len(base)
            if sum(map(len, seen)) > 1 << 20:
                yield portion()
        if seen:
            yield portion()

    return _keyed(docs, id_col, text_col).mapInArrow(run, _FOUND)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def disclosing_terms(detected: DataFrame, *, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(value, term, share): terms that disclose at least `threshold` of a protected value's information.

    With N documents, share = pmi(value, term) / -log p(value), where pmi is the logarithm of
    N * both / (df(value) * df(term)). All counts are of whole documents of the whole corpus. A
    pair must have `support` documents. Values in fewer documents than that can't have them:
    of these only the words of an address itself are candidates, by the same share.

    As `both` is at most df(value), a term with more than N ** (1 - threshold) *
    df(value) ** threshold documents can't disclose it; such terms drop out before pairs are made.
    """
    found = detected.where("text_key is not null")
    total = float(found.count())
    df_term = materialize(detected.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df_term")))
    values = found.where(F.size("values") > 0).select("row", F.explode("values").alias("value"))
    df_value = materialize(values.groupBy("value").agg(F.count("*").alias("df_value")).where(F.col("df_value") < total))
    most = F.pow(F.lit(total), F.lit(1 - threshold)) * F.pow(F.col("df_value"), F.lit(threshold)) * (1 + 1e-9)
    often = df_value.where(F.col("df_value") >= support)
    limit = often.agg(F.max(most)).first()[0]
    seldom = df_value.where(F.col("df_value") < support)
    own = found.where(F.size("own") > 0).select(F.explode("own").alias("p")).select("p.value", "p.term")
    counted = own.join(seldom.hint("merge"), "value").groupBy("value", "term").agg(F.count("*").alias("both"), F.first("df_value").alias("df_value"))
    counted = counted.join(df_term.hint("merge"), "term").select("value", "term", "both", "df_value", "df_term")
    if limit is not None:
        v = materialize(joined_by_count(values, often, "value", "df_value"))
        rows = found.where(F.size("values") > 0).select("row", "words")
        w = filtered(rows, "row", id_filter(v, "row"), inside=True).select("row", F.explode("words").alias("term"))
        w = joined_by_count(w, df_term.where(F.col("df_term").between(support, limit)), "term", "df_term")
        pairs = v.join(w.hint("merge"), "row").where(F.col("df_term") <= most)
        pairs = pairs.groupBy("value", "term").agg(F.count("*").alias("both"), F.first("df_value").alias("df_value"), F.first("df_term").alias("df_term"))
        counted = counted.unionByName(pairs.where(F.col("both") >= support).select(counted.columns))
    share = F.log(F.lit(total) * F.col("both") / (F.col("df_value") * F.col("df_term"))) / F.log(F.lit(total) / F.col("df_value"))
    return counted.select("value", "term", share.alias("share")).where(F.col("share") >= threshold - 1e-12)


def key_bits(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size of hashes, for tasks to rule out others with (`_in`)."""
    maps = (
        keys.select(F.pmod(column, F.lit(_BITS)).alias("b"))
        .distinct()
        .groupBy(F.bitmap_bucket_number("b").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        .collect()  # _BITS / 32768 rows of 4 KB at most
    )
    filled = np.zeros(_BITS // 8 + 4096, dtype=np.uint8)
    for r in maps:  # bucket 0 holds 0, bucket n + 1 holds n * 32768 + 1 to (n + 1) * 32768
        low = (r.bucket - 1) * 4096 if r.bucket else _BITS // 8
        filled[low : low + 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return filled


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h % _BITS
    p = (b - 1) % 32768
    byte = np.where(b == 0, _BITS // 8, (b - 1) // 32768 * 4096 + p // 8)
    return (bits[byte] >> np.where(b == 0, 0, p % 8).astype(np.uint8)) & 1 == 1


def occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, term, places): where each of `terms` (hashes) stands in each document, outside protected values.

    The scan passes on only words whose hash is in a bitmap of fixed size; what the bitmap
    lets through by chance falls out in the join with the terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_bits(terms, "term"))
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, texts, found, places = [], [], [], []
            for i, key, text in zip(*(batch.column(j) for j in range(3)), strict=True):
                text = text.as_py() or ""
                names = list(set(_WORD.findall(text)))
                keys = np.fromiter(map(word_key, names), np.int64, len(names))
                hit = set(keys[_in(bits, keys)].tolist()) if names else set()
                if not hit:
                    continue
                at: dict[int, list[dict]] = {}
                for m in free_words(text, base_spans(text)):
                    if (k := word_key(m.group())) in hit:
                        at.setdefault(k, []).append({"s": m.start(), "e": m.end()})
                for k, p in at.items():
                    ids.append(i.as_py())
                    texts.append(key.as_py())
                    found.append(k)
                    places.append(p)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (ids, texts, found)), pa.array(places, kind)], ["doc_id", "text_key", "term", "places"]
            )

    return _keyed(docs, id_col, text_col).where("text is not null").mapInArrow(run, "doc_id long, text_key long, term long, places array<struct<s:int,e:int>>")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: int = SUPPORT, threshold: float = THRESHOLD, remove: float = REMOVE
) -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base, spans), one row per input row.

    `base` lists what the patterns find, `spans` that and every occurrence, in any document, of
    the terms that disclose a protected value (see `disclosing_terms`): kind `secret` from
    `remove` of its information on, else `term`. Both are kind:start:end by start, then kind,
    comma-joined, in code points with the end exclusive. Null texts count as empty and have none.
    Repeated rows are documents of their own. Only id and text are read, so other columns may
    have any names; an empty table gives an empty result.
    """
    detected = materialize(detect(docs, id_col, text_col))
    found = detected.where("text_key is not null").select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base")
    told = materialize(disclosing_terms(detected, support=support, threshold=threshold).groupBy("term").agg(F.max("share").alias("share"), F.count("*").alias("n")))
    if told.isEmpty():
        return found.withColumn("spans", F.col("base"))
    places = materialize(occurrences(docs, told, id_col, text_col))
    counted = places.groupBy("term").agg(F.count("*").alias("c")).join(told.hint("merge"), "term").select("term", "share", "c")
    level = F.when(F.col("share") >= remove, KINDS.index("secret")).otherwise(KINDS.index("term"))
    marked = joined_by_count(places, counted, "term", "c").withColumn("k", level)
    spots = F.transform("places", lambda p: F.struct(p["s"].alias("s"), F.col("k").alias("k"), p["e"].alias("e")))
    terms = marked.select("doc_id", "text_key", spots.alias("spots")).groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("terms"))
    rows = found.alias("f").join(
        terms.hint("merge").alias("t"), F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.text_key") == F.col("t.text_key")), "left"
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    listed = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(part(x, 2).cast("int").alias("s"), (F.array_position(names, part(x, 1)) - 1).cast("int").alias("k"), part(x, 3).cast("int").alias("e")),
    )
    text = lambda p: F.concat_ws(":", F.element_at(names, p["k"] + 1), p["s"], p["e"])
    both = F.array_join(F.transform(F.sort_array(F.concat(listed, "t.terms")), text), ",")
    return rows.select("f.*", F.when(F.col("t.terms").isNull(), F.col("base")).otherwise(both).alias("spans"))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: int = SUPPORT, threshold: float = THRESHOLD, remove: float = REMOVE
) -> DataFrame:
    """(doc_id, text), one row per input row: protected values give way to the name of their kind, terms to [word] or [number], secrets to nothing."""
    found = find_personal_data(docs, id_col, text_col, support=support, threshold=threshold, remove=remove)
    spans = found.where("spans <> ''").select("doc_id", "text_key", "spans").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replaced(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
    rows = _keyed(docs, id_col, text_col).alias("d").join(spans.alias("p"), same, "left")
    return rows.select("d.doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def replaced(text: str | None, spans: str | None) -> str | None:
    """Overlapping spans count as one, with the kind of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",")):
        s, e = int(s), int(e)
        if s >= at:
            general = "number" if text[s:e].isdigit() else "word"
            out += [text[at:s], "" if kind == "secret" else f"[{general if kind == 'term' else kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """The columns that stand for the spans of find_personal_data in a thin result."""
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
