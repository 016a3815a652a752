"""Queries: joins, assignments, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import arrays as A
from rowforge.functions import scalars as S
from rowforge.operators import matching, ranking, scoring
from rowforge.plans.predicates import vectors
from rowforge.plans.registry import LONG, PAIRS, query
from rowforge.plans.scalar_queries import pairs
from rowforge.session import table

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_C = "SELECT c_custkey AS i, c_name AS n, c_nationkey AS v FROM customer"
_J1 = f"""
WITH base AS ({_C}),
host AS (SELECT i + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS i, replace(upper(n), '#', ' - ') AS n, v FROM base WHERE i % 10 <> 0),
plugin AS (SELECT i, n, v + CASE WHEN i % 11 = 0 THEN 1 ELSE 0 END AS v FROM base UNION ALL SELECT i, lower(n), v FROM base WHERE i % 13 = 0),
preset AS (SELECT i, CASE WHEN i % 17 = 0 THEN n || ' extra' ELSE n END AS n, v FROM base),
norm AS (SELECT 'host' AS source, {_NORM.format('n')} AS k, * FROM host UNION ALL SELECT 'plugin', {_NORM.format('n')}, * FROM plugin UNION ALL SELECT 'preset', {_NORM.format('n')}, * FROM preset),
r AS (SELECT source, k, min(n) AS m, count(*) AS d, min(i) AS j, min(v) AS w FROM norm GROUP BY source, k),
l AS (SELECT source, {_NORM.format('n')} AS k, n, i, v FROM base, (SELECT unnest(['host', 'plugin', 'preset']) AS source)),
met AS (SELECT coalesce(l.n, r.m) AS name, coalesce(l.source, r.source) AS source, l.n, r.m, d, i, j, v, w FROM l FULL JOIN r ON l.source = r.source AND l.k = r.k)
SELECT name, source, CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'unknown' WHEN d > 1 THEN 'ambiguous' ELSE 'index drift' END AS problem FROM met WHERE m IS NULL OR n IS NULL OR d > 1 OR i <> j
UNION ALL SELECT name, source, 'version drift' FROM met WHERE d = 1 AND v <> w"""


@query("j1_identity_join", _J1)
def j1(spark, sf_dir):
    i, n, v = F.col("i"), F.col("n"), F.col("v")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("n"), F.col("c_nationkey").alias("v"))
    host = base.where("i % 10 <> 0").select((i + F.when(i % 7 == 0, 1).otherwise(0)).alias("i"), F.replace(F.upper(n), F.lit("#"), F.lit(" - ")).alias("n"), "v")
    plugin = base.select("i", "n", (v + F.when(i % 11 == 0, 1).otherwise(0)).alias("v")).unionByName(base.where("i % 13 = 0").select("i", F.lower(n).alias("n"), "v"))
    preset = base.select("i", F.when(i % 17 == 0, F.concat(n, F.lit(" extra"))).otherwise(n).alias("n"), "v")
    return matching.identity_join(base, {"host": host, "plugin": plugin, "preset": preset}, "i", "n", "v")


@query("j2_resolve_one", f"""
SELECT r_regionkey, r_name, n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS problem FROM region LEFT JOIN (
 SELECT {_NORM.format("n_name")} AS k, count(*) AS n FROM nation GROUP BY 1) ON k = {_NORM.format("r_name")}""")
def j2(spark, sf_dir):
    left = table(spark, sf_dir, "region").withColumn("k", S.normal_label(F.col("r_name")))
    right = table(spark, sf_dir, "nation").select(S.normal_label(F.col("n_name")).alias("k"))
    n = right.groupBy("k").agg(F.count("*").alias("n"))
    return matching.resolve_one(left, right, "k").join(n, "k", "left").select("r_regionkey", "r_name", "n", "problem")


@query("j3_provenance_agreement", "SELECT s_nationkey, count(DISTINCT substr(s_name, 1, 9)) AS prefixes, count(DISTINCT substr(s_name, 1, 9)) = 1 AS agree FROM supplier GROUP BY s_nationkey")
def j3(spark, sf_dir):
    n = F.countDistinct(F.substring("s_name", 1, 9))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(n.alias("prefixes"), (n == 1).alias("agree"))


@query("j4_grid_matches", """
SELECT p_brand, bool_and(round_even((p_size - 1) / 49.0 * 49, 0) = p_size - 1) AS matches FROM part GROUP BY p_brand""")
def j4(spark, sf_dir):
    raw = S.scaled(F.col("p_size").cast("double"), 1.0, 50.0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_and(F.bround(raw * 49) == F.col("p_size") - 1).alias("matches"))


@query("j5_native_range", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN round_even(1 + u * (p_size - 1), 0) WHEN l_linenumber % 3 = 1 THEN 1 + u * (p_size - 1)
  ELSE 1 + list_position(list_transform([0, 0.26, 0.52, 0.77, 1], lambda c: abs(c::DOUBLE - u)), list_min(list_transform([0, 0.26, 0.52, 0.77, 1], lambda c: abs(c::DOUBLE - u)))) - 1 END, 6) AS native,
 CASE WHEN p_partkey IS NULL THEN 'unknown key' END AS problem
FROM (SELECT *, l_discount * 10 AS u FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 8 <> 3) ON p_partkey = l_partkey""")
def j5(spark, sf_dir):
    host = table(spark, sf_dir, "part").where("p_partkey % 8 <> 3").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(host, F.col("p_partkey") == F.col("l_partkey"), "left")
    kind = F.when(F.pmod("l_linenumber", F.lit(3)) == 0, "stepped").when(F.pmod("l_linenumber", F.lit(3)) == 1, "continuous").otherwise("category")
    x = matching.native_value(F.col("l_discount") * 10, F.lit(1.0), F.col("p_size").cast("double"), kind, F.array(*map(F.lit, (0.0, 0.26, 0.52, 0.77, 1.0))))
    problem = F.when(F.col("p_partkey").isNull(), "unknown key")
    return rows.select("l_orderkey", "l_linenumber", S.rounded(x, 6).alias("native"), problem.alias("problem"))


@query("j6_pair_by_id", "SELECT p.vec_id, t.vec_id IS NOT NULL AS paired FROM embeddings p LEFT JOIN embeddings t ON t.vec_id = p.vec_id + 1")
def j6(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    target = ids.select((F.col("vec_id") - 1).alias("vec_id"), F.lit(True).alias("paired"))
    return ids.join(target, "vec_id", "left").select("vec_id", F.coalesce("paired", F.lit(False)).alias("paired"))


def splits(spark, n):
    """A fifth of n shards each for two splits with seeds of their own, the rest for training."""
    return spark.createDataFrame([(0, "train", n - 2 * (n // 5), None), (1, "val", n // 5, 7), (2, "test", n // 5, 9)], "pos int, split string, shards int, split_seed long")


@query("j7_split_of_shard", """
SELECT o_orderkey, CASE WHEN s < 12 THEN 'train' WHEN s < 16 THEN 'val' WHEN s < 20 THEN 'test' END AS split, CASE WHEN s >= 20 THEN 'outside' END AS problem FROM (SELECT o_orderkey, o_orderkey % 23 AS s FROM orders)""")
def j7(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(23)).alias("shard"))
    return matching.in_range(rows, "shard", ranking.split_ranges(splits(spark, 20))).select("o_orderkey", "split", "problem")


@query("j8_missing_shards", "SELECT k AS shard FROM (SELECT unnest(range((SELECT max(user_id) + 10 FROM events))) AS k) WHERE k NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def j8(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    expected = spark.range((ev.agg(F.max("user_id")).first()[0] or 0) + 10).withColumnRenamed("id", "shard")
    return expected.join(ev.where("event_type = 'purchase'").select(F.col("user_id").alias("shard")), "shard", "left_anti")


@query("j9_insert_absent", """
SELECT user_id AS shard, 'available' AS status FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')
UNION ALL SELECT user_id, 'claimed' FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')""")
def j9(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    old = ev.where("event_type = 'signup'").select(F.col("user_id").alias("shard"), F.lit("claimed").alias("status")).distinct()
    return matching.insert_absent(old, ev.select(F.col("user_id").alias("shard"), F.lit("available").alias("status")), "shard")


@query("j10_worst_pairs", f"""
WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d,
 round(list_cosine_similarity(a.v, b.v), 6) AS c FROM {_E} a JOIN {_E} b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, max(d) AS far, arg_max(i, (d, -i, -j)) AS far_a, arg_max(j, (d, -i, -j)) AS far_b, min(c) AS cosine, arg_max(i, (-c, -i, -j)) AS cosine_a, arg_max(j, (-c, -i, -j)) AS cosine_b FROM p GROUP BY label""")
def j10(spark, sf_dir):
    return scoring.worst_pairs(vectors(spark, sf_dir), "label", "vec_id")


@query("j11_backend_pairs", """
WITH m AS (SELECT l_partkey, l_returnflag, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag AS a, b.l_returnflag AS b, count(*) AS n, round(avg(abs(a.x - b.x)), 4) AS d FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_returnflag < b.l_returnflag GROUP BY 1, 2""")
def j11(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("x"))
    a, b = m.alias("a"), m.alias("b")
    both = a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_returnflag") < F.col("b.l_returnflag")))
    return both.groupBy(F.col("a.l_returnflag").alias("a"), F.col("b.l_returnflag").alias("b")).agg(
        F.count("*").alias("n"), S.rounded(F.avg(F.abs(F.col("a.x") - F.col("b.x"))), 4).alias("d")
    )


_KNN = f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query_id, b.vec_id, c, row_number() OVER (PARTITION BY q.vec_id ORDER BY c DESC, b.vec_id) AS rank FROM (
 SELECT q.vec_id, b.vec_id AS bid, round(list_cosine_similarity(q.v, b.v), 12) AS c FROM {_E} q JOIN {_E} b ON true WHERE q.vec_id % 20 = 0) q JOIN {_E} b ON b.vec_id = q.bid) WHERE rank <= 5"""


@query("j12_exact_neighbours", _KNN)
def j12(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return matching.k_nearest(q, v, 5).select("query_id", "rank", "vec_id", S.rounded("cosine", 6).alias("cosine"))


_J13 = f"""
WITH RECURSIVE p AS (SELECT vec_id, vec_id // 6 AS batch, vec_id % 6 AS i, pred, target FROM {PAIRS}),
c AS MATERIALIZED (SELECT a.batch, a.i, b.i AS j, sqrt(list_sum(list_transform(list_zip(a.pred, b.target), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS cost FROM p a JOIN p b USING (batch)),
o AS (SELECT batch, min(i) AS i, max(i) AS last, 0::BIGINT AS used, 0.0::DOUBLE AS cost FROM p GROUP BY batch
 UNION ALL SELECT o.batch, o.i + 1, last, used | (1::BIGINT << c.j), o.cost + c.cost FROM o JOIN c ON c.batch = o.batch AND c.i = o.i AND (used & (1::BIGINT << c.j)) = 0 WHERE o.i <= last)
SELECT o.batch, n AS rows, round(min(cost), 6) AS total FROM o JOIN (SELECT batch, count(*) AS n FROM p GROUP BY batch) m ON m.batch = o.batch WHERE i = last + 1 GROUP BY o.batch, n"""


@query("j13_batch_assignment", _J13)
def j13(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 6).cast("long"))
    paired = matching.pair_batches(rows, "batch", "vec_id", "pred", "target")
    return paired.groupBy("batch").agg(F.countDistinct("paired").alias("rows"), S.rounded(F.sum("distance"), 6).alias("total"))


def _sinkhorn_sql(rounds: int, reg: float) -> str:
    steps = [f"""s0 AS (SELECT a.vec_id AS g, a.b AS i, c.b AS j, sum((a.v - c.v) * (a.v - c.v)) AS cost, -sum((a.v - c.v) * (a.v - c.v)) / {reg} AS l
 FROM (SELECT vec_id, pos // 8 AS b, pos % 8 AS k, v FROM {LONG}) a JOIN (SELECT vec_id, pos // 8 AS b, pos % 8 AS k, v FROM {LONG}) c ON a.vec_id = c.vec_id AND a.k = c.k GROUP BY ALL)"""]
    for n in range(2 * rounds):
        w = f"OVER (PARTITION BY g, {'ij'[n % 2]})"
        steps.append(f"s{n + 1} AS (SELECT g, i, j, cost, l - ln(sum(exp(l)) {w}) AS l FROM s{n})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT g, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(cost, 6) AS cost, round(exp(l), 6) AS p FROM s{2 * rounds}"


@query("j14_sinkhorn", _sinkhorn_sql(5, 0.5))
def j14(spark, sf_dir):
    s = vectors(spark, sf_dir).select(F.col("vec_id").alias("g"), A.bands("v", 8).alias("s"))
    grid = s.select("g", "s", F.posexplode("s").alias("i", "a")).select("g", "i", "a", F.posexplode("s").alias("j", "b"))
    costs = grid.select("g", "i", "j", A.total(A.squared_error("a", "b")).alias("cost"))
    return matching.sinkhorn(costs, 5, 0.5).select("g", "i", "j", S.rounded("cost", 6).alias("cost"), S.rounded("p", 6).alias("p"))


@query("j15_shuffle_probe", """
SELECT user_id, skipped, count(*) AS n, CASE WHEN skipped IS NULL THEN count(*) ELSE 0 END AS partners, 0::BIGINT AS with_itself FROM events JOIN (
 SELECT user_id, CASE WHEN count(*) < 2 THEN 'too few rows' WHEN max(value > 250) <> min(value > 250) THEN 'settings differ' END AS skipped FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id, skipped""")
def j15(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("settings", (F.col("value") > 250).cast("string"))
    p = matching.shuffle_probe(ev, "user_id", "event_id", "settings", 42)
    return p.groupBy("user_id", "skipped").agg(F.count("*").alias("n"), F.countDistinct("partner").alias("partners"), F.count_if(F.col("event_id") == F.col("partner")).alias("with_itself"))


@query("j15_partners", "SELECT count(*) AS n, count(*) FILTER (vec_id IS NULL) AS with_itself, count(DISTINCT vec_id) AS partners FROM embeddings")
def j15_partners(spark, sf_dir):
    p = matching.shuffled_partner(table(spark, sf_dir, "embeddings"), "vec_id", 42)
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") == F.col("partner")).alias("with_itself"), F.countDistinct("partner").alias("partners"))


@query("j16_uniform_inputs", "SELECT role, count(*) AS n, count(DISTINCT sha256(coalesce(text, ''))) <= 1 AS uniform FROM conversations GROUP BY role")
def j16(spark, sf_dir):
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), (F.countDistinct(digest) <= 1).alias("uniform"))


@query("u1_complete_attempts", """
SELECT user_id, list_sort(list(DISTINCT event_type)) AS markers FROM events GROUP BY user_id
HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'error') < 5""")
def u1(spark, sf_dir):
    from rowforge.operators.production import complete

    return complete(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click", "purchase"], "error", 5)


@query("u2_attempts_by_shard", """
SELECT user_id // 10 AS shard, user_id AS attempt, max(ts) FILTER (event_type = 'purchase') AS valid_at FROM events GROUP BY 1, 2
HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'purchase') > 0""")
def u2(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("shard", F.floor(F.col("user_id") / 10))
    need = [F.count_if(F.col("event_type") == t) > 0 for t in ("view", "click", "purchase")]
    at = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    found = ev.groupBy("shard", F.col("user_id").alias("attempt")).agg(at.alias("valid_at"), (need[0] & need[1] & need[2]).alias("ok"))
    return found.where("ok").drop("ok")


@query("u3_concatenate", "SELECT l_orderkey AS id, l_tax AS metric, 'tax' AS source FROM lineitem UNION ALL SELECT l_orderkey, l_discount, 'discount' FROM lineitem")
def u3(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    one = lambda c, n: rows.select(F.col("l_orderkey").alias("id"), F.col(c).alias("metric"), F.lit(n).alias("source"))
    return one("l_tax", "tax").unionByName(one("l_discount", "discount"))


@query("u4_ordered_distinct", "SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id")
def u4(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first")).orderBy("first")


@query("u5_membership", """
SELECT coalesce(a.p_type, b.p_type) AS name, a.p_type IS NOT NULL AS in_small, b.p_type IS NOT NULL AS in_large
FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 3) a FULL JOIN (SELECT DISTINCT p_type FROM part WHERE p_size > 48) b ON a.p_type = b.p_type""")
def u5(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda where, flag: p.where(where).select(F.col("p_type").alias("name")).distinct().withColumn(flag, F.lit(True))
    both = one("p_size < 3", "in_small").join(one("p_size > 48", "in_large"), "name", "full")
    return both.select("name", F.coalesce("in_small", F.lit(False)).alias("in_small"), F.coalesce("in_large", F.lit(False)).alias("in_large"))


@query("u6_shapes_agree", "SELECT p_brand, count(DISTINCT p_size % 3) AS shapes, count(DISTINCT p_size % 3) = 1 AS agree FROM part GROUP BY p_brand")
def u6(spark, sf_dir):
    n = F.countDistinct(F.col("p_size") % 3)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(n.alias("shapes"), (n == 1).alias("agree"))
