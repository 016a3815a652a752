"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual byte-level pre-tokenizer: contractions, letters, numbers, other characters, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts that Latin-1 can hold, with its letters, numbers and white space spelled out: several times faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t\n\x0b\f\r \x85\xa0"
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Distinct pieces whose ids a worker keeps; beyond it the cache starts anew.
CACHE = 150_000
#: Width of the trees from which as many as FEW pieces are merged one by one: so few rows don't pay for array steps.
LONG = 2048
FEW = 16
_NONE = np.int64(2**62)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library (model BPE, pre-tokenizer and decoder ByteLevel).

    A piece of n bytes takes some 80 n bytes of arrays or 160 n of lists, all of it at once; texts are cut into
    pieces at white space and changes of kind, so only a run of one kind is a long piece.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if unknown := _unsupported(spec):
            raise ValueError(f"{path} has settings that aren't supported: {', '.join(unknown)}")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        _, first = np.unique(keys, return_index=True)  # of equal pairs the first rank counts
        self.merges = keys[first], first.astype(np.int64), merged[first]
        self._index(*self.merges)
        self.numbers = list(range(max(self.bytes_of) + 1))  # one object for each id, however many pieces have it
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.special.items()}

    def _index(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """A hash table of pairs with linear probing, at most a quarter full."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table_key = np.full(1 << bits, -1, dtype=np.int64)
        self.table_rank = np.full(1 << bits, _NONE, dtype=np.int64)
        self.table_id = np.zeros(1 << bits, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.table_key[slot] == -1
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.table_key[slot[put]], self.table_rank[slot[put]], self.table_id[slot[put]] = keys[left[put]], rank[left[put]], made[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent pairs (-1: no neighbour); _NONE where they don't merge."""
        key = np.where((a >= 0) & (b >= 0), (a << 32) | b, -2)
        slot = self._slot(key)
        there = self.table_key[slot]
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.table_key[slot[open_]]
            open_ = open_[(there != key[open_]) & (there != -1)]
        return self.table_rank[slot], self.table_id[slot]

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece. Pieces of like length are rows of one array, each row a segment tree."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        size = [max(1, (len(p) - 1).bit_length()) for p in pieces]
        order = sorted(range(len(pieces)), key=size.__getitem__)
        for depth, group in itertools.groupby(order, size.__getitem__):
            rows = list(group)
            if 1 << depth >= LONG and len(rows) <= FEW:
                for i in rows:
                    out[i] = self._merge_long(pieces[i], 1 << depth)
                continue
            step = max(1, (1 << 18) >> depth)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], 1 << depth), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Leaf i of a tree is the rank of the pair that starts at position i, joined with i; its root is the leftmost lowest rank."""
        n, length = len(pieces), np.array([len(p) for p in pieces])
        place = np.arange(width)
        ids = np.full((n, width), -1, dtype=np.int64)
        inside = place < length[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.where(place + 1 < length[:, None], place + 1, -1).ravel()
        before = np.where(inside, place - 1, -1).ravel()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        rank = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel())[0].reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree, ids = tree.ravel(), ids.ravel()
        live = np.arange(n)
        root = tree[1 :: 2 * width]
        while True:
            live = live[root < _NONE]
            if not len(live):
                break
            at = tree[live * (2 * width) + 1] % width
            row = live * width
            here = row + at
            gone = after[here]
            _, made = self._pairs(ids[here], ids[row + gone])
            ids[here], ids[row + gone] = made, -1
            nxt, prv = after[row + gone], before[here]
            after[here] = nxt
            has, some = nxt >= 0, prv >= 0
            before[(row + nxt)[has]] = at[has]
            right = np.where(has, ids[row + np.maximum(nxt, 0)], -1)
            left = np.where(some, ids[row + np.maximum(prv, 0)], -1)
            ranks, _ = self._pairs(np.concatenate([made, left]), np.concatenate([right, made]))
            k = len(live)
            leaf = np.where(ranks < _NONE, ranks * width + np.concatenate([at, prv]), _NONE)
            base = live * (2 * width)
            tree[base + width + gone] = _NONE
            tree[base + width + at] = leaf[:k]
            tree[(base + width + prv)[some]] = leaf[k:][some]
            # the paths of the three leaves to the root, together; rows without a left neighbour repeat a path
            node = np.concatenate([gone, at, np.where(some, prv, at)]) + width
            base = np.concatenate([base, base, base])
            w = width
            while w > 1:
                node >>= 1
                under = base + 2 * node
                tree[base + node] = np.minimum(tree[under], tree[under + 1])
                w >>= 1
            root = tree[live * (2 * width) + 1]
        kept = ids >= 0
        flat, counts = list(map(self.numbers.__getitem__, ids[kept].tolist())), kept.reshape(n, width).sum(axis=1)
        ends = np.cumsum(counts).tolist()
        return [tuple(flat[e - c : e]) for e, c in zip(ends, counts.tolist(), strict=True)]

    @functools.cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id of each pair that merges."""
        keys, rank, made = (x.tolist() for x in self.merges)
        return dict(zip(keys, zip(rank, made, strict=True), strict=True))

    def _merge_long(self, piece: bytes, width: int) -> tuple[int, ...]:
        """The same tree for one long piece, which has no other rows to share a step with."""
        ranks, none, n = self.ranks, int(_NONE), len(piece)
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [none] * (2 * width)

        def leaf(i: int, a: int, b: int) -> int:
            found = ranks.get(a << 32 | b)
            return found[0] * width + i if found else none

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        for i in range(n - 1):
            tree[width + i] = leaf(i, ids[i], ids[i + 1])
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            at = tree[1] % width
            gone = after[at]
            made = ranks[ids[at] << 32 | ids[gone]][1]
            ids[at], ids[gone] = made, -1
            nxt, prv = after[gone], before[at]
            after[at] = nxt
            put(gone, none)
            put(at, leaf(at, made, ids[nxt]) if nxt >= 0 else none)
            if nxt >= 0:
                before[nxt] = at
            if prv >= 0:
                put(prv, leaf(prv, ids[prv], made))
        return tuple(x for x in ids if x >= 0)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text (null: empty); special tokens in a text become their ids, none are added."""
        for group in _chunks(texts):
            split = [self._split(t or "") for t in group]
            seen = set().union(*split)
            new = seen - self.cache.keys()
            if len(self.cache) + len(new) > CACHE:
                self._forget()
                new = seen - self.cache.keys()
            names = list(new)
            self.cache.update(zip(names, self.merge([p.encode("utf-8", "surrogatepass") for p in names]), strict=True))
            known = self.cache.__getitem__
            for parts in split:
                yield list(itertools.chain.from_iterable(map(known, parts)))

    def _split(self, text: str) -> list[str]:
        """Pieces in order. A special token stands whole, which no other piece does."""
        try:
            text.encode("latin-1")
            find = LATIN.findall
        except UnicodeEncodeError:
            find = self.pieces.findall
        if not self.specials or not any(t in text for t in self.special):
            return find(text)
        out: list[str] = []
        at = 0
        for m in self.specials.finditer(text):
            out += find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + find(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _unsupported(spec: dict) -> list[str]:
    """Settings of a file that would give other ids than this encoder. Truncation and padding are left unused."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    found = [k for k in ("normalizer", "post_processor") if spec.get(k)]
    found += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        found.append("model or decoder")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        found.append("pre_tokenizer")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        found.append("added_tokens")
    return found


def _chunks(texts: Iterable[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` characters, so that new pieces of many texts are merged together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """The tokenizer of a file, once for each Python worker. The file is part of an installed package on every executor."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, in the row order of the input; null counts as empty and gives no ids.

    Null and repeated ids stay; an empty table gives an empty result. Only the two columns are read, whatever others are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column(1).to_pylist(), 1 << 22):
                ids = list(bpe.encode_batch(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                done += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids decoded again, and both digested.

    One row per input row, repeated and null ids too. Null texts count as empty: no tokens,
    digests of the empty string. An empty table gives an empty result. Only the two columns are
    read, whatever others are named. Token ids stay within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        names = list(map(str, bpe.numbers))
        for batch in batches:
            n, a, b = [], [], []
            gc.disable()  # millions of tuples, no cycles
            try:
                for ids in bpe.encode_batch(t.as_py() for t in batch.column(1)):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DIGEST)
