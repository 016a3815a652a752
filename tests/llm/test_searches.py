"""URL filters, hard negatives and spelling variants against brute force, and on odd inputs."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm import hard_negatives, spelling, url_filter

# ---------------------------------------------------------------- URL filters

RULES = "host string, path string, verdict string"


def judged(url, rules, default="allow"):
    """A plain reading of the rules, one by one."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0] + r[1], r[2]))
    return host, path, best[0] + best[1], best[2]


def check_urls(spark, urls, rules):
    pages = spark.createDataFrame(
        [(i, u, "h", "r", "x", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, host string, __row int, short int"
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_equal_a_plain_reading(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 3)
    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "com", "org", "é", ""]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "".join(rng.choice("xyz/é😀") for _ in range(rng.randint(0, 5))) for _ in range(40)] + [""]
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in {(rng.choice(hosts) or "a", rng.choice(paths)) for _ in range(80)}]
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#f?', '/z'])}" for _ in range(600)]
    check_urls(spark, urls, rules)


def test_urls_with_more_shapes_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHAPES", 2)
    check_urls(spark, ["http://a.b.c/x/y", "http://c/", "http://b.c", None, "", "http:///x"], [("c", "/", "allow"), ("b.c", "/x", "block"), ("b.c", "", "block"), ("a.b.c", "/x/y/z", "allow")])


def test_odd_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "", "block")]
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "http://EXAMPLE.org/en/15", "http://org", "http://x.com", "http://xcom/", "http://u@org:80/", "http://org./", "a://b://org/",
            "http://org/\n?", "http://org\n/", "http://" + "a." * 5000 + "org/" + "p" * 100_000, "http://É.org/É"]
    check_urls(spark, urls, rules)
    check_urls(spark, urls, [])
    again = spark.createDataFrame([(1, "http://org/"), (1, "http://com/"), (None, "http://org/")], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge_urls(again, spark.createDataFrame(rules, RULES)).collect()) == ["allow", "allow", "block"]
    assert url_filter.judge_urls(again.limit(0), spark.createDataFrame(rules, RULES)).count() == 0
    both = spark.createDataFrame([("org", "/", "allow"), ("ORG", "/", "block")], RULES)
    assert {r.verdict for r in url_filter.judge_urls(again.limit(1), both).collect()} == {"block"}
    for bad in [("", "/", "allow"), (None, "/", "allow"), ("a", None, "block"), ("a", "/", "deny")]:
        with pytest.raises(ValueError, match="rule"):
            url_filter.judge_urls(again, spark.createDataFrame([bad], RULES))


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score double, rid int, grp string"


def mined(rows, every, k=5, low=80, high=100):
    """All scores, in plain Python."""
    usable = [(j, i, y, [math.floor(256 * c) for c in v]) for j, (i, v, y) in enumerate(rows) if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for j, i, y, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), m, z) for n, m, z, u in usable if n != j and len(u) == len(v))
        for s, m, z in [x for x in scored if x[2] == y][:k]:
            fits = [(t, o) for t, o, q in scored if q != y and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, m, r + 1, o, -s, -t) for r, (t, o) in enumerate(fits)]
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, 0.0, 1, "g") for i, v, y in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **options).collect()))


@pytest.mark.parametrize("block", [40, 5000])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 5))
    rows = []
    for i in range(700):
        v = centers[rng.integers(6)] + rng.normal(size=5) * rng.choice([0.0, 0.05, 0.6])
        rows.append((int(i), [float(c) for c in v * rng.choice([1, 1, 3])], int(rng.choice([0, 0, 0, 1, 2, 3]))))
    rows += [(7, [1.0, 2.0], 0), (20, [1.0, 2.0], 1), (21, [1.0, 1.9], 1), (40, [1.0, 2.1], 0)]
    assert mine(spark, rows, every=20, block=block) == mined(rows, 20)


def test_hard_negatives_of_a_group_beyond_the_split_points(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "REGIONS", 3)
    monkeypatch.setattr(hard_negatives, "BROADCAST_REGIONS", 1)
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4).round(1)], i % 2) for i in range(300)] + [(900 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(200)]
    assert mine(spark, rows, every=30, block=20) == mined(rows, 30)


def test_hard_negatives_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (10, [], 1), (20, [None, 1.0], 1), (30, [nan, 1.0], 1), (40, [inf, 1.0], 1), (50, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (60, [0.0, 0.0], 1), (61, [0.0, 0.0], 1),
            (62, [0.0, 0.0], 2), (70, [1.0, 1.0], 1), (70, [1.0, 1.0], 1), (71, [0.9, 1.0], 2), (71, [0.9, 1.0], 2), (80, [-1.0, -1.0], 5), (-10, [0.5, -0.5], 2)]
    assert mine(spark, rows, every=10) == mined(rows, 10)
    assert mine(spark, [], every=10) == []
    assert mine(spark, [(10, [1.0], 1)], every=10) == []
    with pytest.raises(Exception, match="exact"):
        mine(spark, [(10, [1e200], 1), (11, [1.0], 1)], every=10)


def test_labels_may_be_strings(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], "a" if i % 3 else "b") for i in range(60)], "vec_id long, embedding array<float>, label string")
    rows = [(i, [float(i % 5), 1.0], 0 if i % 3 else 1) for i in range(60)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, every=10).collect())) == mined(rows, 10)


def test_trees_skip_subtrees_outside_the_annulus():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(500, 3)) * 2 + 1000 * c for c in rng.normal(size=(12, 3))])
    tree = hard_negatives.Gnat(np.floor(x), leaf=32)
    seen = []
    asked = hard_negatives.Asked(tree.x[:1], np.array([0]), np.array([0]), np.array([0]), np.array([-np.inf]), np.array([np.inf]), 5, False)
    leaf = asked._leaf
    asked._leaf = lambda x, rows, *rest: (seen.append(len(rows)), leaf(x, rows, *rest))
    asked.search(tree, np.arange(len(x)), np.arange(len(x)), np.ones(len(x), dtype=int))
    best = np.lexsort((np.arange(len(x)), -(tree.x @ tree.x[0])))[:5]
    assert asked.id[0].tolist() == best.tolist()
    assert sum(seen) < len(x) / 4


# ---------------------------------------------------------------- spelling

DOCS = "doc_id long, text string, word string, n int, form string, id int, run string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            w, run = run.translate(UPPER), ""
            if w and i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        ok = best is not None and words[best] >= 10 * n
        out[w] = [best if ok else None, w, n, len(others), words[best] if ok else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def spelled(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "w", 1, "f", 2, "r") for i, t in rows], DOCS)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, **options).collect()}


@pytest.mark.parametrize("block", [3, 40, 20_000])
def test_variants_equal_brute_force(spark, block):
    rng = random.Random(7)
    base = ["".join(rng.choice("abÉß") for _ in range(rng.randint(7, 10))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÉß") + w[at:], w[:at] + rng.choice("ab") + w[at + 1 :]])
            words.append(rng.choice([w, w.title() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    want = variants(rows)
    assert spelled(spark, rows, block=block) == want
    assert len(want) > 300 and sum(r[0] is not None for r in want.values()) > 20


def test_variants_follow_forms_to_the_last(spark):
    rows = [(1, "abcdefgh " * 2000 + "abcdefgi " * 150 + "abcdefji " * 12), (2, "abcdefkji " * 2)]
    got = spelled(spark, rows, noise=None)
    want = {w: 0 for w in ("abcdefgh", "abcdefgi", "abcdefji", "abcdefkji")}
    assert set(got) == set(want)
    assert got["abcdefji"][:2] == ("abcdefgi", "abcdefgh") and got["abcdefgi"][:2] == ("abcdefgh", "abcdefgh") and got["abcdefkji"][1] == "abcdefkji"


def test_variants_of_odd_texts(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "12 . \n"), (None, "lengthy lengthy lengthyx lengthyx"), (4, "Àÿ×÷éèê Àÿ×÷éèê ÀÀÀÀÀÀÀ"), (5, f"{long} {long} {long[:30_000]}z{long[30_000:]}"), (5, f"{long[:30_000]}z{long[30_000:]}"),
            (6, "x" * 64 + " " + "x" * 64 + " " + "x" * 65 + " " + "x" * 65 + " " + ("x" * 66 + " ") * 2), (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa baaaaaa baaaaaa aaaaaab aaaaaab")]
    want = variants(rows)
    assert spelled(spark, rows) == want and spelled(spark, rows, block=1) == want
    assert any(len(w) > 50_000 and r[3] for w, r in want.items())
    assert spelled(spark, []) == {}


def test_pairs_of_an_acceptor_come_once_each():
    rng = random.Random(2)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 50))})
        got = [frozenset(p) for p in spelling.one_edit_pairs(words)]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def test_an_acceptor_is_minimal():
    words = sorted({a + b + c for a in ("", "x", "y") for b in ("in", "on") for c in ("ed", "ing", "")})
    a = spelling.Acceptor(words)
    assert len(set(zip(a.final, (tuple(x.items()) for x in a.arcs), strict=True))) == len(a.arcs)
    assert len(a.arcs) < 12


def test_common_prefixes_are_divided_further(spark):
    words = spark.createDataFrame([("aaaaaaa" + c + d,) for c in "abcdefgh" for d in "abcdefgh"] + [("aaaaaaa",), ("b" * 80,), ("caaaaaaa",)], "word string")
    cuts = {r.word: r.cut for r in spelling._divided(words, 5).collect()}
    assert cuts["aaaaaaa"] == 7 and cuts["b" * 80] == 80 and cuts["caaaaaaa"] == 1 and cuts["aaaaaaabc"] == 9
    assert spelling._divided(words, 5).groupBy(F.expr("left(word, cut)")).count().agg(F.max("count")).first()[0] <= 5
