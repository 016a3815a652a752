"""The training-data operators: brute force, round trips, held-out accuracy, odd inputs."""

import collections
import hashlib
import io
import itertools
import json
import math
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowforge.llm import _shared, bpe, embedding_dedup, exact_dedup, langid, mixing, near_dedup, pii, quality, queries, resharding, warc
from tests.compare import SMALL, connect, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(doc_id, text) with columns that clash with those the operators make."""
    full = [(i, t, "en", None if i is None else f"s{i % 3}", 1, 1, True, 2.0, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", component_id int, kept boolean, score double, rep string")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a"), (5, "x" * 200_000), (6, "word " * 30_000), (7, "é漢字😀 \u0000 end"), (8, "a\r\nb")]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


# ------------------------------------------------------------------ shared


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in _shared.connected_components(e).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    assert _shared.connected_components(e.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in _shared.connected_components(chain).collect()} == {0}


def test_without_ids(spark):
    df = spark.createDataFrame([(i if i % 5 else None, str(i)) for i in range(50)], "k long, x string")
    gone = spark.createDataFrame([(i,) for i in (1, 2, 3, 99)], "k long")
    left = _shared.without_ids(df, "k", gone)
    assert left.columns == df.columns and left.count() == 47


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda key, default: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_folder(N(conf=conf, sparkContext=N(master="spark://host:7077", applicationId="a")))
    assert _shared.shared_folder(N(conf=N(get=lambda key, default: "hdfs://x/y/"))) == "hdfs://x/y"


def test_hot_keys_are_joined_in_place(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY", 2)
    df = spark.createDataFrame([(k, i) for i in range(90) for k in ([7] if i % 3 else [i, None])], "k long, x long")
    counted = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k < 30").withColumn("z", F.col("k") * 2)
    got = sorted(map(tuple, _shared.joined_by_count(df, counted, "k").collect()))
    assert got == sorted(map(tuple, df.join(counted, "k").collect())) and len(got) > 60


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole = _shared.word_hashes(text)
    monkeypatch.setattr(_shared, "_WINDOW", 64)
    assert (whole == _shared.word_hashes(text)).all() and len(set(whole.tolist())) == 97


# ------------------------------------------------------------------ warc


def test_bundle_frames_are_independent():
    out = io.BytesIO()
    w = warc.BundleWriter(out, frame=100)
    data = [bytes([65 + i]) * n for i, n in enumerate((60, 60, 0, 250, 10))]
    places = [w.add(d) for d in data]
    w.finish()
    raw = out.getvalue()
    r = warc.BundleReader(io.BytesIO(raw), len(raw))
    for d, (frame, start) in zip(data, places, strict=True):
        assert r.frame(frame)[start : start + len(d)] == d
    assert b"".join(warc.zstandard.ZstdDecompressor().decompress(raw[a : a + n], max_output_size=p) for a, n, p in r.starts) == b"".join(data)


def test_warc_round_trip_of_odd_pages(spark):
    rows = [(i, None if i == 1 else "http://x/ y\n", t) for i, t in ODD] + [(20, "u", "a\r\n\r\nWARC/1.1"), (21, "u", "a\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("frame", F.lit(2))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder, frame=1000)
    back = warc.read_records(index, folder).collect()
    assert len(back) == len(rows)
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    text = {i: t or "" for i, _, t in rows}
    for r in back:
        if r.page_id is None:
            assert r.record_type == "response" and bytes(r.payload) == b"a"
            continue
        payload = text[r.page_id].encode()
        first = least[text[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.sha1_base32(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    one = index.where("page_id = 20")
    assert bytes(warc.read_records(one, folder).first().payload) == text[20].encode()
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def test_warc_repeated_ids_with_other_payloads(spark):
    rows = [(1, "A"), (5, "A"), (5, "UNIQUE"), (5, "B"), (3, "B"), (5, "A"), (None, "A"), (None, "C"), (7, None), (9, "")]
    folder = warc.archive_folder(spark)
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("id", F.lit(1))
    got = warc.read_records(warc.write_archives(pages, folder), folder).collect()
    want = collections.Counter()
    for i, t in rows:
        first = min((j for j, u in rows if j is not None and (u or "") == (t or "")), default=None)
        revisit = i is not None and first != i
        want[(i, warc.sha1_base32((t or "").encode()), "revisit" if revisit else "response", first if revisit else None, None if revisit else t or "")] += 1
    assert collections.Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got) == want


# ------------------------------------------------------------------ exact


def test_exact_groups(spark):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, ODD)).collect())
    assert got[0] == (0, 4, 3, False)
    assert (1, 2, 2, False) in got and (2, 2, 2, True) in got and got.count((4, 4, 3, True)) == 2
    assert exact_dedup.exact_groups(docs(spark, ODD).limit(0)).count() == 0


def test_exact_heavy_and_rest_agree(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.35 else f"t{rng.randrange(400)}") for i in range(3000)]
    want = collections.defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    for r in exact_dedup.exact_groups(docs(spark, rows), tracked=16, heavy=4).collect():
        group = want[rows[r.doc_id][1]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
    kept = exact_dedup.drop_exact_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(max, want.values()))
    assert kept.columns == docs(spark, rows).columns


def test_exact_drop_goes_by_id_and_text(spark):
    rows = [(5, "a"), (5, "only"), (9, "a"), (None, "a"), (None, "alone"), (None, "alone"), (4, None), (3, "")]
    left = exact_dedup.drop_exact_copies(docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter([(5, "only"), (9, "a"), (None, "alone"), (None, "alone"), (4, None)])


def test_exact_dedup_plan_has_no_python(spark):
    plan = exact_dedup.exact_groups(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


# ------------------------------------------------------------------ BPE

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_equals_the_library(library, text):
    mine = bpe.tokenizer(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert next(iter(mine.encode_batch([text]))) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_odd_texts(library):
    mine = bpe.tokenizer(PATH)
    rng = random.Random(2)
    latin = [chr(x) for x in range(256)] + list(" \n'''sdtmrevl ") * 12
    texts = ["", None, "x" * 20_000, " " * 5000, "<|endoftext|>a<|endoftext|>", "it's 'S ''re", "a\u0085b  c", "'s't"]
    texts += ["".join(rng.choices(latin, k=40)) for _ in range(500)]
    for text, ids in zip(texts, mine.encode_batch(texts), strict=True):
        assert ids == library.encode(text or "", add_special_tokens=False).ids
    ids = [[rng.randrange(50257) for _ in range(12)] for _ in range(300)]
    assert all(mine.decode(x) == library.decode(x, skip_special_tokens=False) for x in ids)


def test_bpe_long_pieces_one_by_one_and_together(monkeypatch, library):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdeth", k=rng.randrange(1500, 9000))) for _ in range(6)] + ["ab" * 3000, "é" * 2500]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(bpe.Bpe(PATH).encode_batch(texts)) == want
    monkeypatch.setattr(bpe, "FEW", 0)
    assert list(bpe.Bpe(PATH).encode_batch(texts)) == want


def test_bpe_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 50)
    mine = bpe.Bpe(PATH)
    texts = [f"word{i} other{i * 7}" for i in range(400)]
    assert list(mine.encode_batch(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_frames(spark, library):
    df = docs(spark, ODD)
    rows = bpe.round_trip(df, PATH).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == bpe.encode(df.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in ODD)


def test_bpe_refuses_other_files(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for where, key, value in (("", "normalizer", {"type": "Lowercase"}), ("model", "ignore_merges", True), ("pre_tokenizer", "add_prefix_space", True)):
        other = json.loads(json.dumps({k: v for k, v in spec.items() if k != "model"} | {"model": spec["model"] | {"vocab": {}, "merges": []}}))
        (other[where] if where else other)[key] = value
        (tmp_path / "t.json").write_text(json.dumps(other))
        with pytest.raises(ValueError, match="aren't supported"):
            bpe.Bpe(str(tmp_path / "t.json"))


# ------------------------------------------------------------------ PII

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    """The contract's patterns as they stand, one after another."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)] if "@" in text else []  # quadratic in long words
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("ab@..0123456789+- ()é%\n", max_size=60))
def test_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_spans_of_known_values():
    text = "a.b@x.org, 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111 or +1 (415) 555-0100 é b@c.d@e.f"
    assert pii.base_spans(text) == plain_spans(text)
    assert [k for _, k, _ in pii.base_spans(text)] == [0, 1, 2, 3, 0]
    long = "1" * 200_000 + "@" + "a" * 100_000
    assert pii.base_spans(long) == []


def test_personal_data_of_odd_and_driver_documents(spark):
    rows = [*ODD, (30, "mail a@b.co now"), (30, "mail a@b.co now"), (None, "1.2.3.4")]
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.base) for r in got) == collections.Counter((i, pii.joined(plain_spans(t or ""))) for i, t in rows)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    thin = pii.digest(pii.find_personal_data(table)).collect()
    assert len(thin) == len(text)
    for r in thin:
        assert r.base_sha256 == hashlib.sha256(pii.joined(plain_spans(text[r.doc_id])).encode()).hexdigest()


def plain_terms(rows, support=3, threshold=0.8):
    """{term: largest share} by sets and dictionaries."""
    values, words, alike = [], [], collections.Counter()
    for _, text in rows:
        text = text or ""
        spans = plain_spans(text)
        values.append({(k, text[s:e].lower()) for s, k, e in spans})
        words.append({m.group().lower() for m in re.finditer(r"\w+", text) if not any(s < m.end() and m.start() < e for s, _, e in spans)})
    df_value, df_term, n = collections.Counter(itertools.chain(*values)), collections.Counter(itertools.chain(*words)), len(rows)
    for v, w in zip(values, words, strict=True):
        alike.update(itertools.product(v, w))
    out = {}
    for (v, t), both in alike.items():
        own = v[0] == 0 and t in {x for x in re.findall(r"[^\W\d_]+", v[1].partition("@")[0]) if len(x) > 2}
        if df_value[v] == n or (both < support if df_value[v] >= support else not own):
            continue
        share = math.log(n * both / (df_value[v] * df_term[t])) / math.log(n / df_value[v])
        if share >= threshold - 1e-12:
            out[t] = max(share, out.get(t, 0))
    return out


def with_terms(text, terms, remove=0.95):
    spans = plain_spans(text)
    free = [m for m in re.finditer(r"\w+", text) if not any(s < m.end() and m.start() < e for s, _, e in spans)]
    more = [(m.start(), 5 if terms[m.group().lower()] >= remove else 4, m.end()) for m in free if m.group().lower() in terms]
    return pii.joined(sorted([*spans, *more]))


def test_terms_equal_plain_counts(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(100):
        words = rng.choices(vocabulary, k=30)
        if i % 5 == 0:
            words += ["zed@corp.org", "Zanzibar_9", "x" * 90, "zanzibar_9"] if i % 20 else ["zed@corp.org"]
        if i % 9 == 0:
            words += ["10.1.2.3", "rarely"]
        if i in (7, 8):
            words += [f"marta.koslow{i}@mail.net", "Koslow"]
        if i == 50:
            words += ["Zanzibar_9", "far away from any value"]
        if i == 51:
            words += ["quartz.lone@mail.net", "quartz", "lonesome"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(3, rows[20][1]), (20, rows[20][1]), (None, rows[25][1]), (101, None), (102, "")]
    terms = plain_terms(rows)
    assert "zanzibar_9" in terms and "quartz" in terms and "rarely" in terms and not {"lonesome", "far", "w1"} & terms.keys()
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.spans) for r in got) == collections.Counter((i, with_terms(t or "", terms)) for i, t in rows)
    clean = pii.sanitise(docs(spark, rows)).collect()
    assert len(clean) == len(rows)
    text = {r.doc_id: r.text for r in clean}
    assert "anzibar" not in text[50] and "far away" in text[50] and "[email]" in text[25] and text[101] is None


def test_sanitised_text():
    assert pii.replaced("ab c@d.e 12 xy", "email:3:8,term:9:11,secret:12:14") == "ab [email] [number] "
    assert pii.replaced("ab cd", "term:0:2") == "[word] cd" and pii.replaced(None, "") is None


def test_personal_data_of_an_empty_table_and_without_values(spark):
    none = docs(spark, ODD).limit(0)
    assert pii.find_personal_data(none).count() == 0 and pii.sanitise(none).count() == 0
    got = pii.find_personal_data(docs(spark, [(1, "no value here"), (2, None)])).collect()
    assert [r.spans for r in got] == ["", ""]


# ------------------------------------------------------------------ resharding


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(30):
        have = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 5))]
        m = rng.randrange(1, 6)
        room = [sum(have) // m + (j < sum(have) % m) for j in range(m)]
        flow = resharding.min_cost_flow(have, room)
        assert [sum(r) for r in flow] == have and [sum(c) for c in zip(*flow, strict=True)] == room
        stays = sum(flow[i][i] for i in range(min(len(have), m)))
        assert stays == sum(min(h, r) for h, r in zip(have, room, strict=False))


def new_folder(spark):
    return f"{_shared.shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("rows", [[(i, f"text {i} " + "x" * (i % 37)) for i in range(3000)], [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)], ODD, []])
def test_shards_obey_the_law(spark, rows):
    df = docs(spark, rows) if rows else docs(spark, ODD).limit(0)
    got = resharding.digest(resharding.reshard(df, new_folder(spark), shards=24)).collect()
    assert len(got) == len(rows)
    slots, sizes, moved, was = collections.defaultdict(list), collections.Counter(), 0, collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        was[r.old_shard] += r.size
        moved += r.size if r.moved else 0
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 and r.moved == (r.shard != r.old_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if len(rows) > 1000:
        total = sum(sizes.values())
        assert max(sizes.values()) - min(sizes[j] for j in range(24)) <= 0.02 * total / 24 + 60
        have, room = [was[i] for i in range(20)], [total // 24 + (j < total % 24) for j in range(24)]
        flow = resharding.min_cost_flow(have, room)
        assert moved <= sum(map(sum, flow)) - sum(flow[i][i] for i in range(20)) + 20 * 80
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_blocks_move_less_than_one_block_a_shard_more_than_the_flow():
    rng = np.random.default_rng(8)
    for olds, shards in ((5, 7), (7, 5), (3, 3), (1, 4), (4, 1)):
        old, size = rng.integers(0, olds, 400), rng.integers(1, 900, 400)
        to = resharding.assign_blocks(old, size, shards, olds)
        have = np.bincount(old, weights=size, minlength=olds).astype(int).tolist()
        total = sum(have)
        flow = resharding.min_cost_flow(have, [total // shards + (j < total % shards) for j in range(shards)])
        least = total - sum(flow[i][i] for i in range(min(olds, shards)))
        assert 0 <= size[to != old].sum() - least + 900 * olds and size[to != old].sum() <= least + sum(size[old == i].max() for i in range(olds))
        load = np.bincount(to, weights=size, minlength=shards)
        assert load.max() - load.min() <= 900


def test_live_shards_that_keep_their_rows_stay(spark):
    old = [0] * 300 + [1] * 100 + [2] * 200 + [5] * 3
    rows = [(i, f"text {i:04d}", o) for i, o in enumerate(old[:600])]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("slot", F.lit(9))
    folder = new_folder(spark)
    before = spark.createDataFrame([(*r[:2], 0, r[2], r[2]) for r in [*rows, (7777, "elsewhere", 99)]], "doc_id long, text string, slot long, old_shard int, shard int")
    before.repartition(1).write.partitionBy("shard").parquet(folder)
    files = lambda n: {r.path for r in spark.read.format("binaryFile").load(f"{folder}/shard={n}").select("path").collect()}
    kept = files(2), files(99)
    got = resharding.reshard(df, folder, shards=3, olds=3, old=F.col("shard"), live=True).collect()
    assert (files(2), files(99)) == kept and {r.shard for r in got} == {0, 1} and len(got) == 400
    back = spark.read.parquet(folder).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted([*(r[:2] for r in rows), (7777, "elsewhere")])
    assert collections.Counter(r.shard for r in back) == {0: 200, 1: 200, 2: 200, 99: 1}
    resharding.reshard(df, folder, shards=2, olds=3, old=F.col("shard"), live=True)
    assert {r.shard for r in spark.read.parquet(folder).collect()} == {0, 1, 99}


# ------------------------------------------------------------------ near duplicates


def brute(rows, n, threshold):
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 100 * threshold * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mutated(rng, words, share):
    return [w if rng.random() > share else f"m{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        rows += [(len(rows) + k, " ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.06])))) for k in range(rng.choice([1, 3, 30]))]
    rows += [(len(rows) + k, " ".join([f"u{rng.randrange(10**6)}" for _ in range(80)] + passage)) for k in range(40)]
    rows += [(len(rows) + k, " ".join(rng.choices(["a", "b", "C"], k=rng.randrange(0, 7)))) for k in range(60)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows, 4, 0.8)
    got = near_dedup.near_duplicates(docs(spark, rows), shingle=4, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_passage_of_two_fifths_makes_no_cell(spark):
    rng = random.Random(4)
    same = " ".join(f"p{i}" for i in range(40))
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(900)]
    rows = [(i, f"{same} {w}") for i, w in enumerate(own)] + [(900 + i, f"{same} {w} end") for i, w in enumerate(own[:30])]
    df = docs(spark, rows)
    sets = near_dedup.sketches(df, "doc_id", "text", 5).select(F.col("doc_id").alias("rep"), "set_key", "n_shingles", "sketch")
    rough = near_dedup.cells(sets, 0.8)
    assert rough.groupBy("leader").count().agg(F.max("count")).first()[0] > 800
    fine = near_dedup._divided(rough, df, "doc_id", "text", 5, 0.8, 256)
    assert fine.groupBy("leader").count().agg(F.max("count")).first()[0] <= 256 and fine.count() < 1000
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=5).collect()}
    assert all(got[900 + i] == i for i in range(30)) and sum(c == i for i, c in got.items()) == 900


def test_input_columns_may_have_the_names_of_helpers(spark):
    extra = ["__mask", "__word", "__n", "__s", "__m", "__rate", "__r", "__o", "__row", "__w", "__v", "row", "rid", "digest"]
    rows = [(i, f"text {i % 4} one two three four five six", f"s{i % 2}", *[f"{c}{i}" for c in extra]) for i in range(24)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *extra])
    before = {r.doc_id: r.asDict() for r in df.collect()}
    for out in (near_dedup.drop_near_copies(df), exact_dedup.drop_exact_copies(df), mixing.mix_sources(df, extras=False), mixing.mix_sources(df)):
        found = out.collect()
        assert found and set(df.columns) <= set(out.columns)
        assert all({k: v for k, v in r.asDict().items() if k in df.columns} == before[r.doc_id] for r in found)


def test_near_duplicates_of_odd_texts(spark):
    got = near_dedup.near_duplicates(docs(spark, ODD), shingle=4).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].kept and by[6].n_shingles == 1
    assert by[None].component_id is None or by[None].component_id == 4
    assert near_dedup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    assert near_dedup.drop_near_copies(docs(spark, ODD)).columns == docs(spark, ODD).columns


def test_near_copies_of_repeated_ids_lose_no_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, "a text of its own that no other row has at all"), (7, "x y z"), (7, "x y z"), (None, base), (9, base + " again"), (8, "seven words that are here only once"), (8, "X Y Z")]
    left = near_dedup.drop_near_copies(docs(spark, rows), shingle=5, threshold=0.8)
    assert left.columns == docs(spark, rows).columns
    kept = collections.Counter((r.doc_id, r.text) for r in left.collect())
    own = [(1, base), rows[2], rows[7], (None, base)]
    assert kept in (collections.Counter([*own, (7, "x y z"), (7, "x y z")]), collections.Counter([*own, (8, "X Y Z")]))


# ------------------------------------------------------------------ language


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_language_of_odd_texts(spark):
    train = [(100 + i, f"the quick brown fox and the dog number {i}", "en") for i in range(30)] + [(200 + i, f"der schnelle braune fuchs und der hund {i}", "de") for i in range(30)]
    df = spark.createDataFrame([(i, t, "en") for i, t in ODD] + [(50, "12345 !!", "en"), (51, "DER HUND", None)] + train, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[50].lang_pred == "und" and got[50].score == 0
    assert got[51].lang_pred == "de" and got[7].lang_pred in {"en", "de"} and not got[None].held_out
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


class PlainKneserNey:
    """The same models with dictionaries and strings."""

    def __init__(self, rows, n=4):
        self.n, self.counts, letters = n, {}, set()
        for text, lang in rows:
            flat = "".join(map(chr, langid.normalized(text)))
            orders = self.counts.setdefault(lang, {k: collections.Counter() for k in range(1, n + 1)})
            orders[n].update(flat[i : i + n] for i in range(len(flat) - n + 1))
        for orders in self.counts.values():
            for k in range(n - 1, 0, -1):
                orders[k].update(gram[1:] for gram in orders[k + 1])
            letters |= set("".join(orders[n]))
        self.letters = len(letters) + 1

    def probability(self, lang, gram):
        if not gram:
            return 1 / self.letters
        counts = self.counts[lang][len(gram)]
        once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
        d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        p = self.probability(lang, gram[1:])
        return max(counts[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p if same else p

    def scores(self, text):
        flat = "".join(map(chr, langid.normalized(text)))
        return {x: np.mean([math.log(self.probability(x, flat[i : i + self.n])) for i in range(len(flat) - self.n + 1)]) for x in sorted(self.counts)}


def test_kneser_ney_is_a_distribution():
    m = PlainKneserNey([("abracadabra the cat sat on the mat " * 3, "x")])
    for history in ("the", "abr", "zzz", "  a"):
        letters = sorted(set("".join(m.counts["x"][4])))
        assert sum(m.probability("x", history + c) for c in [*letters, "\uffff"]) == pytest.approx(1)


@pytest.mark.parametrize("held", [langid.HELD, 0])
def test_languages_equal_a_plain_model(spark, monkeypatch, held):
    monkeypatch.setattr(langid, "HELD", held)
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    rows = [(10 * i + j, " ".join("".join(rng.choices(letters[j : j + 6], k=5)) for _ in range(12)), f"x{j}") for i in range(15) for j in range(4)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    plain = PlainKneserNey([(text, lang) for _, text, lang in train])
    table = spark.createDataFrame([(i, t, lang, 1, 1) for i, t, lang in rows], "doc_id long, text string, lang string, portion int, key int")
    model = langid.fit(table.where(~langid.held_out()))
    assert model.languages == sorted(plain.counts) and model.letters == plain.letters
    odd = [(9000, "abc zzz", "x1"), (9001, "é漢字 😀 abcd", "x2"), (9002, "e", "x0"), *rows[:12]]
    asked = spark.createDataFrame([(i, t, lang) for i, t, lang in odd], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    for i, text, _ in odd:
        s = plain.scores(text)
        best = max(s, key=s.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(model.temperature * (x - s[best])) for x in s.values()), abs=1e-9)


def test_calibration_leaves_its_rows_out_of_the_counts(spark):
    df = spark.createDataFrame([(i, "abcdef" if i < 3 else "uvwxyz", "x") for i in range(9)], "doc_id long, text string, lang string")
    got = {r.gram: (r.c, r.rest) for r in langid.gram_counts(df, "text", "lang", back=F.col("doc_id") < 5).collect()}
    assert got["abcd"] == (3, 0) and got["uvwx"] == (6, 4)


def test_more_languages_than_a_hundred(spark):
    names = [f"l{j:03d}" for j in range(130)]
    word = lambda j: "".join(chr(ord("a") + int(c)) for c in f"{j * 7919 + 10007:07d}")
    rows = [(1000 * i + j, f"{word(j)} {word(j)} " * 3 + "xyz", names[j]) for j in range(130) for i in range(3 if j else 40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    learnt = {want[r.doc_id] for r in got if not r.held_out}
    assert len(learnt) > 100 and all(r.lang_pred == want[r.doc_id] for r in got if want[r.doc_id] in learnt)


# ------------------------------------------------------------------ mixing


def test_poisson_counts_are_the_inversion(spark):
    for rate in (0.0, 0.15, 1.0, 3.7, 40.0):
        us = [random.Random(i).random() for i in range(40)] + [0.0]
        df = spark.createDataFrame([(u, rate) for u in us], "u double, rate double")
        got = [r.k for r in df.select(mixing.poisson_count(F.col("u"), F.col("rate"), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")).alias("k")).collect()]
        assert got == [mixing.expected_copies(rate, u) for u in us]


def test_mixing_meets_weights_and_repeats_itself(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else None, 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df, {"big": 1.0, None: 1.0}, total=6000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 250 and abs(n[None] - 3000) < 250
    again = mixing.mix_sources(df.repartition(5), {"big": 1.0, None: 1.0}, total=6000)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, again.collect()))
    assert mixing.mix_sources(df, {"other": 1.0}).count() == 0 and mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df, extras=False).columns == df.columns
    odd = mixing.mix_sources(docs(spark, ODD), total=50.0).collect()
    for i, rows in itertools.groupby(sorted(odd, key=lambda r: (r.doc_id or 0, r.text or "")), key=lambda r: (r.doc_id or 0, r.text or "")):
        rows = list(rows)
        repeats = sum((j or 0, t or "") == i for j, t in ODD)
        assert sorted(r.replica for r in rows) == sorted(list(range(rows[0].n_copies)) * repeats) and {r.text for r in rows} <= {t for _, t in ODD}


@pytest.mark.parametrize(("rate", "rows"), [(700.0, 3000), (1000.0, 3000), (1_000_000.0, 16)])
def test_large_rates_follow_the_poisson_distribution(spark, rate, rows):
    key = F.col("id").cast("string")
    df = spark.range(0, rows, 1, 8).withColumn("rate", F.lit(rate))
    got = np.sort([r.n for r in df.select(mixing.poisson_copies(key, 17, F.col("rate")).alias("n")).collect()])
    assert abs(got.mean() - rate) < 4 * math.sqrt(rate / rows)
    ks = np.arange(int(rate - 12 * rate**0.5), int(rate + 12 * rate**0.5) + 1)
    cdf = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in ks])
    assert cdf[-1] == pytest.approx(1, abs=1e-6) and ks[0] <= got[0] and got[-1] <= ks[-1]
    share = np.searchsorted(got, ks, side="right") / rows
    assert np.abs(share - cdf).max() < 1.95 / math.sqrt(rows)


def test_mixing_more_sources_than_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}", "en", None if i % 7 == 0 else "hot" if i % 3 else f"s{i}", 1) for i in range(3000)], DOCS)
    few = collections.Counter(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    monkeypatch.setattr(_shared, "HEAVY", 3)
    assert collections.Counter(map(tuple, mixing.mix_sources(df).collect())) == few


def test_mixing_a_rare_source_beside_a_hot_one(spark):
    df = spark.range(0, 100).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "if(id < 5, 'rare', 'hot') AS source", "1L AS n_chars")
    got = mixing.mix_sources(df, {"rare": 1.0, "hot": 1.0}, total=10_000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["rare"] - 5000) < 300 and abs(n["hot"] - 5000) < 300


# ------------------------------------------------------------------ vectors


def vector_brute(rows, cosine):
    ok = {}
    for i, label, v in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        u = np.array(v) / np.abs(v).max()
        ok[i] = (label, u / np.linalg.norm(u))
    up, links = {i: i for i, _, _ in rows}, collections.Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ok, 2):
        if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in up}


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(40):
        center = rng.normal(size=8)
        for _ in range(int(rng.choice([1, 2, 12]))):
            rows.append((center + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.08])).tolist())
    rows = [(i, int(i % 3), v) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, 0, None), (n + 1, 0, []), (n + 2, 0, [0.0] * 8), (n + 3, 0, [1.0, None] * 4), (n + 4, 0, [float("nan")] * 8), (n + 5, None, rows[0][2]), (n + 6, 0, [1.0, 2.0]), (n + 7, 0, [1e-200] * 8), (n + 8, 0, [1e200] * 8), (n + 9, 0, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("part", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, block=block).collect()}
    assert got == vector_brute(rows, 0.98)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 8192])
def test_repeated_rows_count_once_each(spark, block):
    rows = [(1, [1.0, 0.0], 7)] * 3 + [(2, [1.0, 0.001], 7)] + [(i, [-1.0, float(i)], 7) for i in range(10, 16)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.9999, block=block).collect()
    assert sorted((r.vec_id, r.n_links) for r in got if r.vec_id < 10) == [(1, 3), (1, 3), (1, 3), (2, 3)]


# ------------------------------------------------------------------ quality


def test_quality_of_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = quality.score_quality(table, labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    clean = got.where("quality = 1").agg(F.avg("predicted")).first()[0]
    assert right >= 0.98 and clean >= 0.995


def test_lasso_weights_are_the_optimum():
    """The optimum of a convex function is where its gradients say so: 0 for the intercept, the penalty against each weight, no more than it where a weight is 0."""
    rng = np.random.default_rng(3)
    z = (rng.random((400, 12)) < rng.uniform(0.1, 0.9, 12)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + z[:, 2] - 0.5)))).astype(float)
    for penalty in (0.001, 0.01, 0.05):
        b, w = quality.lasso_logistic(z, y, penalty, steps=5000)
        r = 1 / (1 + np.exp(-(b + z @ w))) - y
        gradient = r @ z / len(y)
        on = np.abs(w) > 1e-9
        assert abs(r.mean()) < 1e-6 and np.abs(gradient[on] + penalty * np.sign(w[on])).max(initial=0) < 1e-6
        assert np.abs(gradient[~on]).max(initial=0) <= penalty + 1e-6 and on.sum() >= 2
        short = quality.lasso_logistic(z, y, penalty)[1]
        assert np.abs(short - w).max() < 0.02


def test_a_tree_splits_where_a_plain_search_does():
    data = np.random.default_rng(11)
    x = data.normal(size=(600, 6)).round(1)
    y = (x[:, 2] + x[:, 4] + data.normal(size=600) > 0.3).astype(float)
    for seed in range(6):
        found = quality.tree_rules(x, y, np.random.default_rng(seed), trees=1, depth=1)
        rng = np.random.default_rng(seed)
        rows, features = rng.choice(600, 300, replace=False), rng.choice(6, 3, replace=False)
        gini = lambda p: p.mean() * (1 - p.mean()) if len(p) else 0.0
        gains = {}
        for j in features:
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 99))):
                low, high = y[rows][x[rows, j] <= cut], y[rows][x[rows, j] > cut]
                if min(len(low), len(high)) >= 8:
                    gains[(int(j), float(cut))] = gini(y[rows]) - (len(low) * gini(low) + len(high) * gini(high)) / 300
        (j, side, cut), (k, other, same) = (r[0] for r in found)
        assert (j, cut) == (k, same) and {side, other} == {"<=", ">"} and gains[(j, cut)] == pytest.approx(max(gains.values()))


def test_rules_as_a_column_score_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 300
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], ", ".join(f"s_{s} double" for s in quality.STATISTICS))
    assert np.allclose([r.p for r in df.select(model.column().alias("p")).collect()], model.score(x[:100]))


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert quality.score_quality(docs(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality.score_quality(docs(spark, ODD).limit(0), labels).count() == 0
    assert quality.keep_good(docs(spark, ODD), labels).columns == docs(spark, ODD).columns


def test_quality_whatever_the_columns_are_named(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 1), (6, 0)], "doc_id long, quality int").withColumn("text", F.lit("t")).withColumn("y", F.lit(3))
    plain = quality.keep_good(docs(spark, ODD), labels)
    df = docs(spark, ODD)
    for c in ("y", "s_chars", "s__words", "__id", "id", "quality", "held_out", "predicted"):
        df = df.withColumn(c, F.lit(1))
    got = quality.keep_good(df, labels)
    assert got.columns == df.columns and sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert quality.score_quality(df, labels).count() == len(ODD)


# ------------------------------------------------------------------ pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, library):
    import corpus_pipeline as p

    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(table, labels)
    rows = [r for r in table.collect() if model.score(np.array([quality.statistics(r.text)]))[0] >= quality.PASS]
    last = {}
    for r in rows:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    rows = [r for r in rows if last[r.text or ""] == r.doc_id]
    groups = brute([(r.doc_id, r.text) for r in rows], 5, 0.8)
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    n = collections.Counter(r.source for r in rows)
    want = collections.Counter()
    for r in rows:
        u = int(hashlib.md5(f"copies:17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += mixing.expected_copies(len(rows) / (len(n) * n[r.source]), u)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in p.run(spark, SMALL).collect())
    assert got == +want
    assert [name for name, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline as p

    odd = docs(spark, [*ODD, (4, "other"), (11, "word " * 30_000)]).withColumn("y", F.lit(1)).withColumn("s_chars", F.lit(1))
    for table in (odd, odd.limit(0)):
        for name, stage in p.STAGES[1:]:
            got = stage(spark, table, SMALL)
            rows = got.collect()
            assert len(rows) <= 100 and (rows or table is not odd)
            if name != "bpe":
                assert got.columns == table.columns
    assert p.STAGES[0][1](spark, odd, SMALL).columns == odd.columns and p.STAGES[0][1](spark, odd.limit(0), SMALL).count() == 0
    assert {r.text for r in p.drop_exact_copies(spark, odd, SMALL).where("doc_id in (6, 11) or doc_id = 4").collect()} == {"word " * 30_000, "other", "a"}


def clustered(n):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(n // 20, 16))
    x = np.repeat(centers, 20, axis=0) + rng.normal(size=(n // 20 * 20, 16)) * 0.01
    return [(i, [float(c) for c in r], 1) for i, r in enumerate(x)]


def test_clusters_meet_only_themselves(spark):
    """Beyond 64 blocks of a label, too, work grows with the vectors, not with their square."""
    sent = {}
    for n in (1000, 4000):
        df = spark.createDataFrame(clustered(n), "vec_id long, embedding array<double>, label int")
        usable = df.select("vec_id", F.xxhash64("vec_id").alias("tie"), F.lit("g").alias("grp"), F.col("embedding").alias("u")).withColumn("grp", F.lit("16:1"))
        unit = usable.select("vec_id", "tie", "grp", F.expr("transform(u, c -> c / sqrt(aggregate(u, 0D, (s, x) -> s + x * x)))").alias("u"))
        large = _shared.materialize(unit.groupBy("grp").agg(F.count("*").alias("rows")))
        sent[n] = embedding_dedup._met(_shared.materialize(unit), large, 16, 0.98).count()
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, cosine=0.98, block=16).collect()}
        assert all(v == (19, i // 20 * 20) for i, v in got.items())
    assert sent[4000] < 6 * sent[1000], sent


def test_copies_and_outliers_end_the_division(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(150)] + [(200, [0.0, 1.0], 1), (201, [-1.0, 0.1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, cosine=0.98, block=10).collect()}
    assert got[200] == (0, 200) and got[201] == (0, 201) and all(got[i] == (149, 0) for i in range(150))


def test_vectors_of_many_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 5), rng.normal(size=4).round(1).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "MAX_GROUPS", 2)
    monkeypatch.setattr(embedding_dedup, "PIVOT_BYTES", 100)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, cosine=0.98, block=12).collect()}
    assert got == vector_brute(rows, 0.98)
