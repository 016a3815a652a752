import math
import random
import zlib

import numpy as np
import pytest

from rowforge.llm import langid
from tests.llm.test_llm import PlainKneserNey


class WithoutOne(PlainKneserNey):
    """Counts of all rows but one, with the discounts and letters of all."""

    def __init__(self, rows, i):
        super().__init__(rows[:i] + rows[i + 1 :])
        whole = PlainKneserNey(rows)
        self.letters = whole.letters
        self.discounts = {x: {k: self.discount(c) for k, c in orders.items()} for x, orders in whole.counts.items()}

    def discount(self, counts):
        once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
        return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)

    def probability(self, lang, gram):
        if not gram:
            return 1 / self.letters
        counts, d = self.counts[lang][len(gram)], self.discounts[lang][len(gram)]
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        p = self.probability(lang, gram[1:])
        return max(counts[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p if same else p


@pytest.mark.parametrize("held, block", [(langid.HELD, langid._BLOCK), (langid.HELD, 60), (0, langid._BLOCK)])
def test_every_row_is_scored_without_itself(spark, monkeypatch, held, block):
    monkeypatch.setattr(langid, "HELD", held)
    rng = random.Random(7)
    words = lambda j: ["".join(rng.choices("abcdefghijkl"[2 * j : 2 * j + 5], k=4)) for _ in range(6)]
    known = [words(j) for j in range(3)]
    rows = [(" ".join(rng.choices(known[j], k=5) + words(j)[:1]), f"x{j}") for _ in range(4) for j in range(3)]
    rows += [rows[0], ("aaaa aaaa aaaa", "x1"), ("q", "x0"), ("one text only", "alone")]
    table = spark.createDataFrame([(i, False, lang, t) for i, (t, lang) in enumerate(rows)], "doc_id long, held_out boolean, lang string, text string")
    model = langid.fit(table)
    monkeypatch.setattr(langid, "_BLOCK", block)
    got = {r.doc_id: r for r in langid.scored(table.coalesce(1), model, (1, 20)).collect()}
    for i, (text, lang) in enumerate(rows):
        if lang == "alone":
            assert got[i].own is None
            continue
        s = PlainKneserNey(rows).scores(text) | {lang: WithoutOne(rows, i).scores(text)[lang]}
        assert got[i].own == pytest.approx(s[lang], abs=1e-9)
        assert got[i].shares == pytest.approx([math.exp(t * (s[lang] - max(s.values()))) / sum(math.exp(t * (x - max(s.values()))) for x in s.values()) for t in (1, 20)], abs=1e-9)


def test_limits_and_temperature_come_from_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh"[2 * (i % 2) : 2 * (i % 2) + 6], k=5)) for _ in range(8)), f"x{i % 2}") for i in range(80)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert np.isfinite(model.limits).all()
    found = langid.scored(table.selectExpr("doc_id", "false AS held_out", "lang", "text"), model, langid.TEMPERATURES).collect()
    losses = [np.mean([-math.log(max(r.shares[i], 1e-9)) for r in found]) for i in range(len(langid.TEMPERATURES))]
    assert len(found) == len(rows) and model.temperature == langid.TEMPERATURES[int(np.argmin(losses))]
    for j, lang in enumerate(model.languages):
        own = np.array([r.own for r in found if r.lang == lang])
        assert model.limits[j] == pytest.approx(np.quantile(-own, 0.99) + 3 * own.std(), abs=1e-3)


def test_one_pass_gives_what_fit_and_predict_give(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh"[2 * (i % 2) : 2 * (i % 2) + 6], k=5)) for _ in range(8)), f"x{i % 2}") for i in range(80)]
    rows += [(None, "abc", "x0"), (90, None, "x1"), (91, "123", "x1"), (92, "qqq zzz", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id IS NOT NULL").where(~langid.held_out()))
    one, two = (sorted(map(repr, df.collect())) for df in (langid.identify(table), langid.predict(table, model)))
    assert one == two and len(one) == len(rows)
