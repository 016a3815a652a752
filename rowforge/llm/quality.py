"""Quality classification by a sparse rule ensemble over text statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import shingles_of, word_hashes
from rowforge.llm.langid import held_out

#: Labelled rows, at most, that a model is fitted on; those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Score from which a document passes.
PASS = 0.7

STATISTICS = (
    "chars", "words", "word_len", "upper", "digit", "bang", "symbol", "pipe", "punct", "space", "wide", "distinct", "top_word",
    "shingles", "lines", "line_words", "same_lines",
)


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; null counts as empty, and every share of nothing is 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = word_hashes(data)
    k = len(words)
    each = np.unique(words, return_counts=True)[1] if k else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    of = lambda chars: float(sum(count[c] for c in chars)) / n
    spaces = of(b" \t\n\r\x0b\x0c")
    return [
        float(n), float(k), n * (1 - spaces) / max(k, 1), float(count[65:91].sum()) / n, float(count[48:58].sum()) / n, of(b"!"), of(b"#$%&*@^~=<>{}[]\\_+"),
        of(b"|"), of(b".,;:?'\"()-"), spaces, float(count[128:].sum()) / n, (len(each) if k else 0) / max(k, 1), float(each.max()) / max(k, 1),
        len(shingles_of(words, 4)) / max(k - 3, 1) if k else 0.0, float(len(lines)), k / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
    ]


def statistics_prefix(columns: list[str]) -> str:
    """What the statistics' columns begin with: s_, or with more underscores where the input has such columns."""
    prefix, taken = "s_", [c.lower() for c in columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def with_statistics(docs: DataFrame, *columns: Column, text_col: str = "text", keep_text: bool = False, prefix: str = "s_") -> DataFrame:
    """The given columns of each row, with `keep_text` the text behind them, then the statistics of the text, named with `prefix`."""
    rows = docs.select(*columns, F.col(f"`{text_col}`").alias(f"{text_col}"))
    kept = rows.schema[: len(columns) + keep_text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{prefix}{s} double" for s in STATISTICS)])
    names = [*(f.name for f in kept), *(f"{prefix}{s}" for s in STATISTICS)]
    at, first = len(columns), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                texts = part.column(at).cast(pa.string())
                stats = np.array([statistics(t.as_py()) for t in texts]).reshape(part.num_rows, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns[:first], *(pa.array(stats[:, j]) for j in range(len(STATISTICS)))], names)

    return rows.mapInArrow(run, schema)


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, *, trees: int = 60, depth: int = 3) -> list[Rule]:
    """The paths of small trees, each grown on half of the rows and half of the statistics, as conjunctions."""
    found: dict[Rule, None] = {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 99))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # value <= cut i: bin <= i

    def grow(rows: np.ndarray, path: Rule, features: np.ndarray, level: int) -> None:
        if level == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (1e-4, None, None)
        base, ones = len(rows), y[rows].sum()
        gini = ones / base * (1 - ones / base)
        for j in features:
            k = np.cumsum(np.bincount(bins[rows, j], minlength=len(cuts[j]) + 1))[:-1]
            p = np.cumsum(np.bincount(bins[rows, j], weights=y[rows], minlength=len(cuts[j]) + 1))[:-1]
            ok = np.flatnonzero((k >= 8) & (base - k >= 8))
            if not len(ok):
                continue
            k, p = k[ok], p[ok]
            gain = gini - (p * (1 - p / k) + (ones - p) * (1 - (ones - p) / (base - k))) / base
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(j), float(cuts[j][ok[i]]))
        if best[1] is None:
            return
        _, j, cut = best
        v = x[rows, j]
        for side, part in (("<=", rows[v <= cut]), (">", rows[v > cut])):
            rule = (*path, (j, side, cut))
            found[rule] = None
            grow(part, rule, features, level + 1)

    for _ in range(trees):
        rows = rng.choice(len(y), max(1, min(len(y) // 2, 4000)), replace=False)
        grow(rows, (), rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False), 0)
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, side, cut in rule:
        out &= x[:, j] <= cut if side == "<=" else x[:, j] > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept isn't penalised."""
    n, k = z.shape
    total = z.sum(axis=0, dtype=np.float64)
    gram = np.block([[np.array([[float(n)]]), total[None, :]], [total[:, None], (z.T @ z).astype(np.float64)]])
    rate = 4 * n / float(np.linalg.eigvalsh(gram)[-1])
    b, w = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(k)
    b2, w2, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(b2 + z @ w2.astype(z.dtype), -35, 35).astype(np.float64))) - y
        b1 = b2 - rate * r.mean()
        w1 = w2 - rate * (r.astype(z.dtype) @ z).astype(np.float64) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - rate * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b2, w2 = b1 + (t - 1) / t1 * (b1 - b), w1 + (t - 1) / t1 * (w1 - w)
        b, w, t = b1, w1, t1
    return b, w


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def to_json(self) -> str:
        return json.dumps([self.intercept, self.rules, self.weights])

    @staticmethod
    def from_json(text: str) -> RuleModel:
        intercept, rules, weights = json.loads(text)
        return RuleModel(intercept, [tuple(tuple(c) for c in r) for r in rules], weights)

    def column(self, prefix: str = "s_") -> Column:
        """The score as a Spark expression over the columns <prefix><statistic>."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            each = [F.col(f"{prefix}{STATISTICS[j]}") <= cut if side == "<=" else F.col(f"{prefix}{STATISTICS[j]}") > cut for j, side, cut in rule]
            test = each[0]
            for e in each[1:]:
                test = test & e
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, *, seed: int = 7, penalty: float = 0.001) -> RuleModel:
    """A constant for no rows or labels of one kind."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    rules = tree_rules(x, y, np.random.default_rng(seed))
    if not rules:
        p = float(np.clip(y.mean(), 0.01, 0.99))
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    seen: dict[bytes, int] = {}  # rules that hold for the same rows count once
    for i, r in enumerate(rules):
        seen.setdefault(np.packbits(holds(r, x)).tobytes(), i)
    first = list(seen.values())
    z = np.empty((len(x), len(first)), dtype=np.float32)
    for k, i in enumerate(first):
        z[:, k] = holds(rules[i], x)
    b, w = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b), [rules[first[i]] for i in kept], [float(w[i]) for i in kept])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fit on labelled rows that aren't held out, `sample` of them at most (by hash of the id, so any layout gives the same).

    One task fits the model on the sample's statistics, a few numbers for each of at most
    `sample` rows; the driver gets the rules.

    A document with several labels counts with the lowest; null labels and ids don't count.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    train = texts.join(F.broadcast(chosen), "__id")  # at most `sample` rows of two numbers
    rows = with_statistics(train, F.col("__id").alias("id"), F.col("y")).distinct()

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["id", *(f"s_{s}" for s in STATISTICS)], kind="stable")
        return pd.DataFrame({"model": [fit_rules(f[[f"s_{s}" for s in STATISTICS]].to_numpy(float), f["y"].to_numpy(float)).to_json()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "model string").first()
    return RuleModel.from_json(found.model) if found else fit_rules(np.empty((0, len(STATISTICS))), np.empty(0))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; null and empty texts are scored as empty.

    Only the text is scored. Repeated ids are scored each; an empty table gives an empty
    result, an empty or one-sided labels table a constant score.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = with_statistics(docs, F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col=text_col)
    return rows.withColumn("score", model.column()).select("doc_id", "held_out", "score", (F.col("score") >= PASS).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns as they are, whatever they are named.

    Null and empty texts are scored as empty texts; repeated rows pass or go together. An empty
    table gives an empty result; without labels every row has the same score of 0.5 and goes.
    """
    model = fit(docs, labels, text_col=text_col)
    rest = [c for c in docs.columns if c != text_col]
    prefix = statistics_prefix(docs.columns)
    rows = with_statistics(docs, *(F.col(f"`{c}`") for c in rest), text_col=text_col, keep_text=True, prefix=prefix)
    return rows.where(model.column(prefix) >= PASS).select(*(f"`{c}`" for c in docs.columns))
