"""Queries: winners, ranges, batches, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import arrays as A
from rowforge.functions import scalars as S
from rowforge.operators import metrics, ranking, signals
from rowforge.plans.joins import splits
from rowforge.plans.predicates import vectors
from rowforge.plans.registry import LONG, PAIRS, query
from rowforge.plans.scalar_queries import pairs
from rowforge.session import table

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("w1_winner", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w1(spark, sf_dir):
    return ranking.earliest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("w2_preferred_winner", """
WITH e AS (SELECT user_id, event_id, ts, event_type = 'view' AND value > 60 AS ok, event_id = max(event_id) OVER (PARTITION BY user_id) AS recorded FROM events)
SELECT user_id, arg_min(event_id, (NOT recorded, ts, event_id)) FILTER (ok) AS winner, count(*) FILTER (NOT ok) AS unhealthy, CASE WHEN count(*) FILTER (ok) = 0 THEN 'no healthy candidate' END AS problem FROM e GROUP BY user_id""")
def w2(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    recorded = ev.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    healthy = (F.col("event_type") == "view") & (F.col("value") > 60)
    return ranking.winners(ev.select("user_id", "event_id", "ts", "event_type", "value"), "user_id", "event_id", ["ts", "event_id"], healthy, recorded)


@query("w3_latest", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def w3(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w4_balanced_split", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS worker FROM orders")
def w4(spark, sf_dir):
    placed = ranking.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    n = placed.agg(F.count("*").alias("n"))
    return placed.crossJoin(F.broadcast(n)).select("o_orderkey", ranking.balanced(F.col("i"), F.col("n"), 7).alias("worker"))


@query("w5_shard_table", """
WITH m AS (SELECT max(o_orderkey // 1000) + 1 AS n FROM orders), r AS (SELECT n - 2 * (n // 5) AS a, n - n // 5 AS b, unnest(range(n)) AS shard FROM m)
SELECT shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 6, '0') AS filename, CASE WHEN shard < a THEN 'train' WHEN shard < b THEN 'val' ELSE 'test' END AS split,
 CASE WHEN shard < a THEN 42 + shard WHEN shard < b THEN 7 ELSE 9 END AS seed, CASE WHEN shard < a THEN 0 WHEN shard < b THEN (shard - a) * 1000 ELSE (shard - b) * 1000 END AS "offset" FROM r""")
def w5(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 1000) + 1).first()[0]
    return ranking.shard_table(splits(spark, n), 1000, 42)


@query("w5_split_problems", """
WITH s AS (SELECT p_brand AS split, count(*) AS rows, min(p_partkey) % 4 AS seed FROM part GROUP BY p_brand)
SELECT split, 'size is no multiple' AS problem FROM s WHERE rows % 3 <> 0 UNION ALL SELECT split, 'seed is not its own' FROM s WHERE seed IN (SELECT seed FROM s GROUP BY seed HAVING count(*) > 1)""")
def w5_problems(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("split")).agg(F.count("*").alias("rows"), (F.min("p_partkey") % 4).alias("split_seed"))
    return ranking.split_problems(s, "rows", 3)


@query("w6_split_ranges", "SELECT p_brand AS split, CAST(sum(count(*)) OVER (ORDER BY p_brand) - count(*) AS BIGINT) AS lo, CAST(sum(count(*)) OVER (ORDER BY p_brand) AS BIGINT) AS hi FROM part GROUP BY p_brand")
def w6(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("split")).agg(F.count("*").alias("shards")).withColumn("pos", F.col("split"))
    return ranking.split_ranges(sizes).select("split", "lo", "hi")


@query("w7_first_accepted", """
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'clipped' WHEN value < 60 THEN 'silent' END AS reason FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 4),
w AS (SELECT user_id, min(event_id) FILTER (reason IS NULL) AS accepted FROM a GROUP BY user_id)
SELECT a.user_id, any_value(accepted) AS accepted, count(*) FILTER (reason = 'clipped' AND (accepted IS NULL OR event_id < accepted)) AS rejected_clipped,
 count(*) FILTER (reason = 'silent' AND (accepted IS NULL OR event_id < accepted)) AS rejected_silent, CASE WHEN any_value(accepted) IS NULL THEN 'budget used up' END AS problem FROM a JOIN w USING (user_id) GROUP BY a.user_id""")
def w7(spark, sf_dir):
    reason = F.when(F.col("event_type") == "error", "clipped").when(F.col("value") < 60, "silent")
    attempts = table(spark, sf_dir, "events").withColumn("reason", reason)
    return ranking.first_accepted(attempts, "user_id", "event_id", "reason", ["clipped", "silent"], budget=4)


_POS = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"


@query("w8_batches", f"SELECT o_orderkey, i, i // 64 AS batch FROM {_POS} WHERE i // 64 < (SELECT count(*) // 64 FROM orders)")
def w8(spark, sf_dir):
    return ranking.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64)


@query("w9_rank_batches", f"SELECT o_orderkey, i // 64 AS batch, CAST((i // 64) % 4 AS INTEGER) AS rank FROM {_POS}")
def w9(spark, sf_dir):
    b = ranking.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, drop_last=False)
    return b.select("o_orderkey", "batch", F.pmod("batch", F.lit(4)).cast("int").alias("rank"))


@query("w10_epoch_blocks", f"SELECT o_orderkey, CAST(e AS INTEGER) AS epoch, i + e * (SELECT count(*) FROM orders) AS idx FROM {_POS}, range(3) t(e)")
def w10(spark, sf_dir):
    placed = ranking.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    n = placed.agg(F.count("*").alias("n"))
    return placed.crossJoin(F.broadcast(n)).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "o_orderkey", "epoch", (F.col("i") + F.col("epoch") * F.col("n")).alias("idx")
    )


@query("w11_repeat_first_batch", f"SELECT a.o_orderkey, b.o_orderkey AS as_key FROM {_POS} a JOIN {_POS} b ON b.i = a.i % 32")
def w11(spark, sf_dir):
    placed = ranking.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    first = placed.where("i < 32").select(F.col("o_orderkey").alias("as_key"), F.col("i").alias("k"))
    return placed.join(F.broadcast(first), F.pmod("i", F.lit(32)) == F.col("k")).select("o_orderkey", "as_key")


@query("w12_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def w12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(100)


@query("w13_sort_by_argsort", f"SELECT vec_id, list_transform(list_grade_up(v), lambda i: CAST(i - 1 AS INTEGER)) AS keys FROM {_E}")
def w13(spark, sf_dir):
    keys = F.transform(F.array_sort(F.transform("v", lambda x, i: F.struct(x.isNull().alias("none"), x.alias("x"), i.alias("i")))), lambda s: s["i"])
    return vectors(spark, sf_dir).select("vec_id", keys.alias("keys")).orderBy("keys", "vec_id")


@query("w14_center_of_mass", f"SELECT vec_id, round(sum(abs(v) * pos) / sum(abs(v)), 5) AS center FROM {LONG} GROUP BY vec_id")
def w14(spark, sf_dir):
    mass = F.transform("v", lambda x: F.abs(x))
    moment = A.total(F.transform(mass, lambda x, i: x * i))
    return vectors(spark, sf_dir).select("vec_id", S.rounded(moment / A.total(mass), 5).alias("center")).orderBy("center", "vec_id")


@query("w15_onset", f"SELECT vec_id, coalesce(min(pos) FILTER (abs(v) > 0.2), -1) AS onset FROM {LONG} GROUP BY vec_id")
def w15(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", A.onset("v", 0.2).cast("long").alias("onset"))


@query("w16_wasserstein", f"""
WITH h AS (SELECT vec_id, pos, abs(a) / sum(abs(a)) OVER (PARTITION BY vec_id) - abs(b) / sum(abs(b)) OVER (PARTITION BY vec_id) AS d
 FROM (SELECT vec_id, generate_subscripts(pred, 1) AS pos, unnest(pred) AS a, unnest(target) AS b FROM {PAIRS}))
SELECT vec_id, round(avg(abs(c)), 6) AS distance FROM (SELECT vec_id, sum(d) OVER (PARTITION BY vec_id ORDER BY pos) AS c FROM h) GROUP BY vec_id""")
def w16(spark, sf_dir):
    hist = lambda c: F.transform(c, lambda x: F.abs(x) / A.total(F.transform(c, lambda y: F.abs(y))))
    return pairs(spark, sf_dir).select("vec_id", S.rounded(A.wasserstein(hist("pred"), hist("target")), 6).alias("distance"))


_ENV = """list_transform(range(0, 9), lambda f: sqrt(list_sum(list_transform(range(f * 8 - 8, f * 8 + 8), lambda i: CASE WHEN i >= 0 AND i < 64 THEN {x}[i + 1] * {x}[i + 1] ELSE 0 END)) / 16))"""


@query("w17_rms_cosine", f"SELECT vec_id, round(list_cosine_similarity({_ENV.format(x='pred')}, {_ENV.format(x='target')}), 6) AS cosine FROM {PAIRS}")
def w17(spark, sf_dir):
    a, b = (A.rms_envelope(c, 16, 8) for c in ("pred", "target"))
    guarded = F.when(A.norm(a) * A.norm(b) < 1e-12, 0.0).otherwise(A.cosine(a, b))
    return pairs(spark, sf_dir).select("vec_id", S.rounded(guarded, 6).alias("cosine"))


def _frames_sql(rows: str, name: str, window: int, hop: int) -> str:
    """CTE `name` (vec_id, f, k, m): Hann-windowed magnitudes of centered frames of (vec_id, pos, v), by the definition of the transform."""
    at = f"(pos - (f * {hop} - {window // 2}))"
    part = lambda fn: f"pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * {at} / {window})) * {fn}(2 * pi() * k * {at} / {window})), 2)"
    return f"""{name} AS MATERIALIZED (SELECT vec_id, f, k, sqrt({part('cos')} + {part('sin')}) AS m FROM {rows}, range({64 // hop + 1}) a(f), range({window // 2 + 1}) b(k)
 WHERE {at} >= 0 AND {at} < {window} GROUP BY vec_id, f, k)"""


_SIDES = f"""p AS (SELECT vec_id, label, generate_subscripts(pred, 1) - 1 AS pos, unnest(pred) AS v FROM {PAIRS}),
t AS (SELECT vec_id, label, generate_subscripts(target, 1) - 1 AS pos, unnest(target) AS v FROM {PAIRS})"""
_TRANSPORT = f"""
WITH {_SIDES}, {_frames_sql('p', 'sp', 16, 8)}, {_frames_sql('t', 'st', 16, 8)},
d AS (SELECT vec_id, f, k, p.m / greatest(sum(p.m) OVER (PARTITION BY vec_id, f), 1e-6) - t.m / greatest(sum(t.m) OVER (PARTITION BY vec_id, f), 1e-6) AS x FROM sp p JOIN st t USING (vec_id, f, k)),
c AS (SELECT vec_id, f, abs(sum(x) OVER (PARTITION BY vec_id, f ORDER BY k)) AS y FROM d)
SELECT vec_id, round(avg(w), 6) AS sot FROM (SELECT vec_id, f, sum(y) / 9 AS w FROM c GROUP BY vec_id, f) GROUP BY vec_id"""


@query("w18_spectral_transport", _TRANSPORT)
def w18(spark, sf_dir):
    return signals.spectral_transport(pairs(spark, sf_dir), window=16, hop=8)


_RATE, _SCALES = 4000, ((16, 8, 6), (32, 16, 8), (64, 32, 10))
_HZ = "(CASE WHEN {0} < 15 THEN {0} * 200 / 3.0 ELSE 1000 * exp(({0} - 15) * ln(6.4) / 27) END)"


def _mel_sql() -> str:
    top = f"(15 + 27 * ln({_RATE / 2} / 1000) / ln(6.4))"
    steps = []
    for n, (window, hop, bands) in enumerate(_SCALES):
        edge = lambda o, bands=bands: _HZ.format(f"((b + {o}) * {top} / {bands + 1})")
        hz = f"(k * {_RATE}.0 / {window})"
        weight = f"greatest(0, least(({hz} - {edge(0)}) / ({edge(1)} - {edge(0)}), ({edge(2)} - {hz}) / ({edge(2)} - {edge(1)}))) * 2 / ({edge(2)} - {edge(0)})"
        steps.append(f"w{n} AS (SELECT b, k, {weight} AS w FROM range({bands}) x(b), range({window // 2 + 1}) y(k))")
        for side in ("p", "t"):
            steps.append(_frames_sql(side, f"s{side}{n}", window, hop))
            steps.append(f"""m{side}{n} AS (SELECT vec_id, f, b, 10 * log10(greatest(sum(m * m * w), 1e-10)) AS db FROM s{side}{n} JOIN w{n} USING (k) GROUP BY vec_id, f, b)""")
            steps.append(f"d{side}{n} AS (SELECT vec_id, f, b, greatest(db - max(db) OVER (PARTITION BY vec_id), -80) AS db FROM m{side}{n})")
        steps.append(f"r{n} AS (SELECT vec_id, avg(abs(p.db - t.db)) AS x FROM dp{n} p JOIN dt{n} t USING (vec_id, f, b) GROUP BY vec_id)")
    return f"WITH {_SIDES}, " + ",\n".join(steps) + "\nSELECT vec_id, round((r0.x + r1.x + r2.x) / 3, 6) AS mss FROM r0 JOIN r1 USING (vec_id) JOIN r2 USING (vec_id)"


@query("w19_multi_scale", _mel_sql())
def w19(spark, sf_dir):
    return signals.multi_scale(pairs(spark, sf_dir), _SCALES, rate=_RATE)


_DFT = """SELECT vec_id, label, k, sqrt(pow(sum(v * cos(2 * pi() * k * pos / 64)), 2) + pow(sum(v * sin(2 * pi() * k * pos / 64)), 2)) AS m FROM {0}, range(33) b(k) GROUP BY vec_id, label, k"""
_BOTH = f"WITH {_SIDES}, sp AS ({_DFT.format('p')}), st AS ({_DFT.format('t')}) "


@query("a20_log_spectral", _BOTH + """SELECT round(avg(l), 6) AS lsd, count(*) AS batches FROM (SELECT label, avg(x) AS l FROM (
 SELECT vec_id, label, sqrt(avg(pow(10 * log10(greatest(pow(p.m / 64, 2), 1e-8)) - 10 * log10(greatest(pow(t.m / 64, 2), 1e-8)), 2))) AS x FROM sp p JOIN st t USING (vec_id, label, k) GROUP BY vec_id, label) GROUP BY label)""")
def a20(spark, sf_dir):
    found = metrics.over_updates(pairs(spark, sf_dir), {"lsd": metrics.LogSpectral()}, "label")
    return found.select(S.rounded("value", 6).alias("lsd"), F.col("updates").alias("batches"))


@query("a21_spectral_l1", _BOTH + """SELECT round(avg(l), 6) AS l1, count(*) AS batches FROM (SELECT label, avg(x) AS l FROM (
 SELECT vec_id, label, avg(abs(p.m - t.m)) AS x FROM sp p JOIN st t USING (vec_id, label, k) GROUP BY vec_id, label) GROUP BY label)""")
def a21(spark, sf_dir):
    found = metrics.over_updates(pairs(spark, sf_dir), {"l1": metrics.SpectralL1()}, "label")
    return found.select(S.rounded("value", 6).alias("l1"), F.col("updates").alias("batches"))


@query("w20_fit_frames", f"SELECT vec_id, list_transform(range(1, 81), lambda i: round(v[least(i, 64)], 6)) AS fitted FROM {_E}")
def w20(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.transform(A.fitted("v", 80), lambda x: S.rounded(x, 6)).alias("fitted"))


@query("w21_adaptive_pool", f"""
SELECT vec_id, list_transform(range(5), lambda i: round(list_avg(v[CAST(floor(i * 64 / 5.0) AS BIGINT) + 1:CAST(ceil((i + 1) * 64 / 5.0) AS BIGINT)]), 6)) AS mean,
 list_transform(range(5), lambda i: round(list_max(v[CAST(floor(i * 64 / 5.0) AS BIGINT) + 1:CAST(ceil((i + 1) * 64 / 5.0) AS BIGINT)]), 6)) AS top FROM {_E}""")
def w21(spark, sf_dir):
    rounded = lambda c: F.transform(c, lambda x: S.rounded(x, 6))
    return vectors(spark, sf_dir).select("vec_id", rounded(A.adaptive_pool("v", 5)).alias("mean"), rounded(A.adaptive_pool("v", 5, F.array_max)).alias("top"))


_FRAMES = f"WITH {_frames_sql(LONG, 's', 16, 8)} "


@query("w22_loudness", _FRAMES + """, d AS (SELECT vec_id, f, 20 * log10(greatest(sqrt(avg(m * m)), 1e-10)) AS db FROM s GROUP BY vec_id, f)
SELECT vec_id, CAST(f AS INTEGER) AS frame, round((greatest(db - max(db) OVER (PARTITION BY vec_id), -80) + 80) / 80, 6) AS loudness FROM d""")
def w22(spark, sf_dir):
    return signals.frames(vectors(spark, sf_dir), window=16, hop=8).select("vec_id", "frame", "loudness")


@query("w23_spectral_centroid", _FRAMES + "SELECT vec_id, CAST(f AS INTEGER) AS frame, round(log2(greatest(sum(m * k) / greatest(sum(m), 1e-12), 1)), 6) AS centroid FROM s GROUP BY vec_id, f")
def w23(spark, sf_dir):
    return signals.frames(vectors(spark, sf_dir), window=16, hop=8).select("vec_id", "frame", "centroid")


@query("w24_lag_rule", f"""
WITH o AS (SELECT vec_id, label, coalesce(min(pos) FILTER (abs(v) > 0.2), -1) AS onset FROM {LONG} GROUP BY vec_id, label), m AS (SELECT label, min(onset) FILTER (vec_id % 2 = 0 AND onset >= 0) AS e FROM o GROUP BY label)
SELECT vec_id, onset, onset - e AS lag FROM o JOIN m USING (label) WHERE vec_id % 2 = 1 AND onset > e + 4""")
def w24(spark, sf_dir):
    o = vectors(spark, sf_dir).select("vec_id", "label", A.onset("v", 0.2).cast("long").alias("onset"))
    control = o.where("vec_id % 2 = 0 and onset >= 0").groupBy("label").agg(F.min("onset").alias("e"))
    late = o.where("vec_id % 2 = 1").join(control, "label").where(F.col("onset") > F.col("e") + 4)
    return late.select("vec_id", "onset", (F.col("onset") - F.col("e")).alias("lag"))
