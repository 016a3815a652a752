"""Queries: scalar functions, hashes, encoding by a spec table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import arrays as A
from rowforge.functions import encoding as E
from rowforge.functions import scalars as S
from rowforge.plans.predicates import vectors
from rowforge.plans.registry import PAIRS, query
from rowforge.session import table

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SEED = "CAST(('0x' || substr(sha256({}), 1, 16))::UBIGINT AS DECIMAL(20,0))"
_UNIT = "(CAST(('0x' || substr(sha256({}), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0)"


def pairs(spark, sf_dir):
    """(vec_id, label, pred, target): each vector as a prediction of the one with the next id."""
    v = vectors(spark, sf_dir)
    target = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("target"))
    return v.withColumnRenamed("v", "pred").join(target, "vec_id")


@query("f1_sample_seed", f"SELECT o_orderkey, {_SEED.format(chr(39) + '42:' + chr(39) + ' || o_orderkey || ' + chr(39) + ':0' + chr(39))} AS seed FROM orders")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sha_seed(F.lit(42), F.col("o_orderkey"), F.lit(0)).alias("seed"))


@query("f2_personalised_seed", f"SELECT o_orderkey, {_SEED.format(chr(39) + 'sample:42:' + chr(39) + ' || o_orderkey')} AS seed FROM orders")
def f2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sha_seed(F.lit("sample"), F.lit(42), F.col("o_orderkey")).alias("seed"))


@query("f3_framed_digest", """
SELECT o_orderkey, sha256(unhex(lpad(upper(hex(len(a))), 16, '0')) || encode(a) || unhex(lpad(upper(hex(len(b))), 16, '0')) || encode(b)) AS digest
FROM (SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders)""")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.framed_digest(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query("f4_request_digest", """SELECT o_orderstatus, sha256('{"limit":' || count(*) || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders GROUP BY o_orderstatus""")
def f4(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("limit"))
    request = F.to_json(F.struct("limit", F.col("o_orderstatus").alias("status")))
    return n.select("o_orderstatus", F.sha2(request.cast("binary"), 256).alias("digest"))


@query("f5_subset_name", "SELECT o_orderkey, substr(o_orderpriority, 1, 8) || '-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS name FROM orders")
def f5(spark, sf_dir):
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.substring("o_orderpriority", 1, 8), F.lit("-"), F.substring(digest, 1, 8)).alias("name"))


@query("f6_run_id", "SELECT o_orderkey, o_orderpriority || '-' || strftime(o_orderdate, '%Y%m%dT%H%M%S%gZ') AS run_id FROM orders")
def f6(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.utc_run_id(F.col("o_orderpriority"), F.col("o_orderdate")).alias("run_id"))


@query("f7_prefix", """
SELECT o_orderkey, 'data/' || trim(o_orderpriority, '/') || '/' || o_orderkey AS prefix, o_orderkey % 2 = 0 AS matches FROM orders""")
def f7(spark, sf_dir):
    prefix = F.concat_ws("/", F.lit("data"), F.trim(F.col("o_orderpriority"), F.lit("/")), F.col("o_orderkey"))
    other = F.concat_ws("/", F.lit("data"), F.trim(F.col("o_orderpriority"), F.lit("/")), F.col("o_orderkey") + F.pmod("o_orderkey", F.lit(2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", prefix.alias("prefix"), (prefix == other).alias("matches"))


@query("f8_parse_run_id", "SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '#([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "#([0-9]+)$", 1).try_cast("long").alias("number"))


@query("f9_utc_only", """SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN date_trunc('second', ts) END AS at FROM events""")
def f9(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("+00:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", S.utc_only(text).alias("at"))


@query("f10_normal_label", "SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS label FROM part")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.normal_label(F.col("p_name")).alias("label"))


@query("f11_common_prefix", """
SELECT a.p_partkey, coalesce((SELECT max(i) FROM range(1, least(len(a.p_name), len(b.p_name)) + 1) t(i) WHERE a.p_name[1:i] = b.p_name[1:i]), 0) AS n
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def f11(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.length(S.common_prefix(F.col("p_name"), F.col("b"))).cast("long").alias("n"))


@query("f12_rename", "SELECT p_partkey, replace(regexp_replace(p_brand, '^Brand#', ''), '1', 'one') AS name FROM part")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.regexp_replace("p_brand", "^Brand#", ""), F.lit("1"), F.lit("one")).alias("name"))


@query("f13_prompt", "SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_partkey) AS prompt FROM part GROUP BY p_brand")
def f13(spark, sf_dir):
    names = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(names, lambda x: x["p_name"]), ", ").alias("prompt"))


@query("f14_provenance", """
SELECT event_id, '{"event":' || event_id || CASE WHEN value > 50 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}' AS debug FROM events""")
def f14(spark, sf_dir):
    row = F.struct(F.col("event_id").alias("event"), F.when(F.col("value") > 50, F.col("event_type")).alias("kind"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(row).alias("debug"))


@query("f15_cosine", f"SELECT vec_id, round(least(greatest(list_cosine_similarity(pred, target), -1), 1), 6) AS cosine FROM {PAIRS}")
def f15(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", S.rounded(A.cosine("pred", "target"), 6).alias("cosine"))


@query("f16_self_similarity", f"""
WITH s AS (SELECT vec_id, unnest(range(8)) AS i, unnest(list_transform(range(8), lambda i: v[i * 8 + 1:i * 8 + 8])) AS x FROM {_E})
SELECT a.vec_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(list_dot_product(a.x, b.x) / list_dot_product(b.x, b.x), 5) AS s FROM s a JOIN s b USING (vec_id)""")
def f16(spark, sf_dir):
    s = vectors(spark, sf_dir).select("vec_id", A.bands("v", 8).alias("s"))
    grid = s.select("vec_id", "s", F.posexplode("s").alias("i", "a")).select("vec_id", "i", "a", F.posexplode("s").alias("j", "b"))
    return grid.select("vec_id", "i", "j", S.rounded(A.dot("a", "b") / A.dot("b", "b"), 5).alias("s"))


@query("f17_latent_mse", f"""
SELECT vec_id, round(list_sum(list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64
 / (list_aggregate(target, 'var_pop') + 1e-6), 5) AS d FROM {PAIRS}""")
def f17(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", S.rounded(A.mean(A.squared_error("pred", "target")) / (A.var_pop("target") + 1e-6), 5).alias("d"))


@query("f18_decibels", f"SELECT vec_id, list_transform(range(1, 33), lambda i: round(10 * log10(greatest(v[i] * v[i] + v[i + 32] * v[i + 32], 1e-8)), 5)) AS db FROM {_E}")
def f18(spark, sf_dir):
    power = F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda r, i: r * r + i * i)
    return vectors(spark, sf_dir).select("vec_id", F.transform(power, lambda p: S.rounded(S.decibels(p), 5)).alias("db"))


@query("f19_midi", "SELECT p_partkey, round(69 + 12 * log2(greatest(p_retailprice, 8) / 440), 6) AS pitch FROM part")
def f19(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.rounded(S.midi_pitch(F.col("p_retailprice")), 6).alias("pitch"))


@query("f20_frame_count", "SELECT doc_id, 1 + n_chars // 160 AS frames FROM documents")
def f20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.frame_count(F.col("n_chars"), 160).alias("frames"))


@query("f21_min_max", "SELECT l_orderkey, l_linenumber, round(l_discount / 0.1, 6) AS u, round(l_discount, 6) AS back FROM lineitem")
def f21(spark, sf_dir):
    u = S.scaled(F.col("l_discount"), 0.0, 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(u, 6).alias("u"), S.rounded(S.unscaled(u, 0.0, 0.1), 6).alias("back"))


@query("f22_one_hot", "SELECT p_partkey, list_transform(range(1, 51), lambda i: CASE WHEN i = p_size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot, p_size AS back FROM part")
def f22(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.one_hot(F.col("p_size"), 1, 50).alias("hot"))
    return p.select("p_partkey", "hot", (S.arg_max(F.col("hot")) + 1).cast("int").alias("back"))


@query("f23_nearest_choice", """
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS choice FROM (SELECT p_partkey, list_position(d, list_min(d)) AS i
 FROM (SELECT p_partkey, list_transform(range(5), lambda k: abs(k / 4.0::DOUBLE - (p_size - 1) / 49.0::DOUBLE)) AS d FROM part))""")
def f23(spark, sf_dir):
    raw = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: k / 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", S.nearest((F.col("p_size") - 1) / 49.0, raw).cast("int").alias("choice"))


@query("f24_sorted_pair", "SELECT o_orderkey, list_sort([o_orderkey % 7, o_custkey % 7]) AS pair FROM orders")
def f24(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_sort(F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 7)).alias("pair"))


def spec(spark):
    rows = [(0, "p_size", "int", 1.0, 50.0, None), (1, "p_retailprice", "float", 900.0, 2100.0, None), (2, "p_group", "category", None, None, ["0", "1", "2", "3"])]
    return spark.createDataFrame(rows, E.SPEC)


def part_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    group = F.pmod("p_partkey", F.lit(4)).cast("string")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("p_size", F.col("p_size").cast("string")), ("p_retailprice", F.col("p_retailprice").cast("string")), ("p_group", group))))),
    )


_ENC = "[(p_size - 1) / 49.0::DOUBLE, (p_retailprice - 900) / 1200.0::DOUBLE, (p_partkey % 4 = 0)::INT, (p_partkey % 4 = 1)::INT, (p_partkey % 4 = 2)::INT, (p_partkey % 4 = 3)::INT]"


@query("f25_encode_row", f"SELECT p_partkey AS id, list_transform({_ENC}, lambda x: round(x, 6)) AS encoded FROM part")
def f25(spark, sf_dir):
    return E.encode(part_settings(spark, sf_dir), spec(spark)).select("id", F.transform("encoded", lambda x: S.rounded(x, 6)).alias("encoded"))


@query("f26_decode_row", """
SELECT p_partkey AS id, p_size AS size, round(p_retailprice, 4) AS price, CAST(p_partkey % 4 AS VARCHAR) AS grp FROM part""")
def f26(spark, sf_dir):
    back = E.decode(E.encode(part_settings(spark, sf_dir), spec(spark)), spec(spark))
    wide = back.groupBy("id").pivot("name", ["p_size", "p_retailprice", "p_group"]).agg(F.first("value"))
    return wide.select("id", F.col("p_size").cast("int").alias("size"), S.rounded(F.col("p_retailprice").cast("double"), 4).alias("price"), F.col("p_group").alias("grp"))


@query("f27_weighted_draw", f"""
SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'sine' WHEN u < 0.8 THEN 'saw' ELSE 'noise' END AS shape FROM (SELECT o_orderkey, {_UNIT.format("'shape:' || o_orderkey")} AS u FROM orders)""")
def f27(spark, sf_dir):
    u = S.unit_draw(F.lit("shape"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.weighted_choice(u, ["sine", "saw", "noise"], [5, 3, 2]).alias("shape"))


@query("f28_point_mass", f"""
SELECT o_orderkey, round(CASE WHEN {_UNIT.format("'a:' || o_orderkey")} < 0.25 THEN 0 ELSE 2 + {_UNIT.format("'b:' || o_orderkey")} * 6 END, 6) AS x FROM orders""")
def f28(spark, sf_dir):
    key = F.col("o_orderkey")
    x = E.point_mass(S.unit_draw(F.lit("a"), key), S.unit_draw(F.lit("b"), key), 2.0, 8.0, 0.25, 0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.rounded(x, 6).alias("x"))


@query("f29_round_robin", "SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS parameter FROM orders")
def f29(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(3)).cast("int").alias("parameter"))


@query("f30_redraw_one", f"""
SELECT p_partkey AS id, CAST(p_partkey % 2 AS INTEGER) AS parameter, round(abs({_UNIT.format("'redraw:' || p_partkey")} - CASE WHEN p_partkey % 2 = 0 THEN (p_size - 1) / 49.0::DOUBLE
 ELSE (p_retailprice - 900) / 1200.0::DOUBLE END), 6) AS change FROM part""")
def f30(spark, sf_dir):
    rows = E.encode(part_settings(spark, sf_dir), spec(spark))
    which = F.pmod("id", F.lit(2)).cast("int")
    u = S.unit_draw(F.lit("redraw"), F.col("id"))
    shifted = F.transform("encoded", lambda x, i: F.when(i == which, u).otherwise(x))
    change = A.norm(F.zip_with(shifted, "encoded", lambda a, b: a - b))
    return rows.select("id", which.alias("parameter"), S.rounded(change, 6).alias("change"))


@query("f31_envelope_report", f"""
SELECT label, count(*) AS n, count(*) FILTER (d > 1.2) AS far, count(*) FILTER (c < -0.3) AS opposed FROM (SELECT label,
 sqrt(list_sum(list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, list_cosine_similarity(pred, target) AS c FROM {PAIRS}) GROUP BY label""")
def f31(spark, sf_dir):
    d = F.sqrt(A.total(A.squared_error("pred", "target")))
    return pairs(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(d > 1.2).alias("far"), F.count_if(A.cosine("pred", "target") < -0.3).alias("opposed")
    )


@query("f32_last_number", r"""
SELECT doc_id, TRY_CAST(list_last(regexp_extract_all(text, 'on\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)', 1)) AS DOUBLE) AS n FROM documents""")
def f32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.last_number(F.col("text"), "on").alias("n"))


@query("f33_json_metric", "SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, TRY_CAST(props->>'$.none' AS DOUBLE) AS none FROM events")
def f33(spark, sf_dir):
    number = lambda path: F.get_json_object("props", path).try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", number("$.k").alias("k"), number("$.none").alias("none"))


_KIND = "CASE WHEN n < 2 THEN 'skip' WHEN n <= 16 THEN 'one-hot' ELSE 'continuous' END"


@query("f34_draft_kind", "SELECT name, n, " + _KIND + """ AS kind FROM (SELECT unnest(['p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name,
 unnest([count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size), count(DISTINCT p_retailprice)]) AS n FROM part)""")
def f34(spark, sf_dir):
    names = ["p_brand", "p_type", "p_size", "p_retailprice"]
    long = table(spark, sf_dir, "part").select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in names))))
    n = long.distinct().groupBy("name").agg(F.count("v").alias("n"))
    return n.select("name", "n", F.when(F.col("n") < 2, "skip").when(F.col("n") <= 16, "one-hot").otherwise("continuous").alias("kind"))


@query("f35_ranked_seed", f"""
SELECT o_orderkey, CAST((CAST({_SEED.format("'42:' || o_orderkey")} AS HUGEINT) + (o_orderkey % 8) * 4) % 18446744073709551616 AS DECIMAL(20,0)) AS seed FROM orders""")
def f35(spark, sf_dir):
    base = S.sha_seed(F.lit(42), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.ranked_seed(base, F.pmod("o_orderkey", F.lit(8)), 4).alias("seed"))


@query("f36_delay", f"SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= label THEN 0 ELSE round(v[i - label], 6) END) AS delayed FROM {_E}")
def f36(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.transform(A.delayed("v", F.col("label").cast("int")), lambda x: S.rounded(x, 6)).alias("delayed"))


@query("f37_fill_batch", """
WITH b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, CAST(i AS INTEGER) AS i, o_orderkey FROM b WHERE i < 8
UNION ALL SELECT o_custkey, CAST(unnest(range(n, 8)) AS INTEGER), f FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM b GROUP BY o_custkey) WHERE n < 8""")
def f37(spark, sf_dir):
    from rowforge.operators.ranking import filled_batches

    return filled_batches(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 8)
