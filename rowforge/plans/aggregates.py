"""Queries: aggregations and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import arrays as A
from rowforge.functions import scalars as S
from rowforge.operators import metrics, moments, scoring, stats
from rowforge.plans.predicates import vectors
from rowforge.plans.registry import LONG, PAIRS, query
from rowforge.plans.scalar_queries import pairs
from rowforge.session import table

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_STATS = f"SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM {LONG}"
_SQ = "list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
_LONGSQ = f"(SELECT vec_id, label, CAST(generate_subscripts(pred, 1) - 1 AS INTEGER) AS pos, unnest(pred) AS p, unnest(target) AS t FROM {PAIRS})"


def _round(df, *columns, digits=6):
    return df.withColumns({c: S.rounded(c, digits) for c in columns})


def _seconds(ts):
    return F.unix_seconds(ts.cast("timestamp"))


def _by_label(spark, sf_dir):
    """The states of each label's vectors, one for each block of positions."""
    return moments.merged(moments.states(vectors(spark, sf_dir), ["label"]), ["label"])


def _all(states):
    return stats.finalise(moments.by_position(moments.merged(states, []), []))


@query("a1_channel_stats", _STATS + " GROUP BY pos")
def a1(spark, sf_dir):
    return _round(stats.finalise(stats.channel_states(vectors(spark, sf_dir), [])).drop("m2"), "mean", "std")


@query("a2_merge_partials", _STATS + " GROUP BY pos")
def a2(spark, sf_dir):
    return _round(_all(_by_label(spark, sf_dir)).select("pos", "n", "mean", "std"), "mean", "std")


@query("a3_finalise_masked", f"""
SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN sd <= 0.127 THEN 1 ELSE round(sd, 6) END AS std FROM (SELECT pos, stddev_pop(v) AS sd FROM {LONG} GROUP BY pos)""")
def a3(spark, sf_dir):
    done = stats.finalise(stats.channel_states(vectors(spark, sf_dir), []), mask=True, least=0.127)
    return done.select("pos", S.rounded("std", 6).alias("std"))


@query("a3_refusals", f"""
SELECT label, CAST(pos AS INTEGER) AS pos, CASE WHEN n <= 1 THEN 'too few rows' ELSE 'no variance' END AS problem FROM (
 SELECT label, pos, count(*) AS n, var_pop(CASE WHEN pos % 3 = 0 THEN 0 ELSE v END) AS s FROM {LONG} WHERE pos % 5 <> 0 OR vec_id < 10 GROUP BY label, pos) WHERE n <= 1 OR s <= 0""")
def a3_refusals(spark, sf_dir):
    there = F.transform("v", lambda x, i: F.when((i % 5 != 0) | (F.col("vec_id") < 10), F.when(i % 3 == 0, 0.0).otherwise(x)))
    rows = vectors(spark, sf_dir).select("label", there.alias("v"))
    return stats.refusals(stats.channel_states(rows, ["label"]).where("n > 0")).select("label", "pos", "problem")


@query("a4_degenerate", f"""
WITH z AS (SELECT CAST(pos AS INTEGER) AS pos FROM (SELECT pos, stddev_pop(CASE WHEN pos % 2 = 0 THEN 0 ELSE v END) AS sd FROM {LONG} GROUP BY pos) WHERE sd <= 0)
SELECT count(*) AS n, list_sort(list(pos))[1:20] AS positions, greatest(count(*) - 20, 0) AS more FROM z""")
def a4(spark, sf_dir):
    half = F.transform("v", lambda x, i: F.when(i % 2 == 0, 0.0).otherwise(x))
    return stats.degenerate(stats.finalise(stats.channel_states(vectors(spark, sf_dir).withColumn("v", half), [])))


@query("a5_shard_partials", f"SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v) * count(*), 5) AS m2 FROM {LONG} GROUP BY label, pos")
def a5(spark, sf_dir):
    return _round(_round(stats.channel_states(vectors(spark, sf_dir), ["label"]), "mean"), "m2", digits=5)


@query("a5_empty_shards", """
SELECT CAST(s AS INTEGER) AS shard, 'empty shard' AS problem FROM range(14) t(s) WHERE s NOT IN (SELECT label FROM embeddings WHERE vec_id % 3 <> 0 OR label <> 4)""")
def a5_empty(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("vec_id % 3 <> 0 or label <> 4").withColumnRenamed("label", "shard")
    return stats.shard_states(rows, "shard", spark.range(14).select(F.col("id").cast("int").alias("shard")))[1]


@query("a6_many_shards", _STATS + " GROUP BY pos")
def a6(spark, sf_dir):
    return _round(_all(_by_label(spark, sf_dir)).select("pos", "n", "mean", "std"), "mean", "std")


@query("a7_train_split_stats", _STATS + " WHERE label < 7 GROUP BY pos")
def a7(spark, sf_dir):
    return _round(_all(_by_label(spark, sf_dir).where("label < 7")).select("pos", "n", "mean", "std"), "mean", "std")


_PROFILE = """
WITH l AS (SELECT {key} AS g, pos, v FROM {long}),
c AS (SELECT g, pos, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY g, pos)
SELECT {out} round(min(mean), 6) AS mean_min, round(quantile_cont(mean, 0.5), 6) AS mean_median, round(max(mean), 6) AS mean_max, round(min(std), 6) AS std_min,
 round(quantile_cont(std, 0.5), 6) AS std_median, round(max(std), 6) AS std_max, count(*) FILTER (std < 1e-6) AS dead, any_value(gm) AS global_mean, any_value(gs) AS global_std
FROM c JOIN (SELECT g, round(avg(v), 6) AS gm, round(stddev_pop(v), 6) AS gs FROM l GROUP BY g) w USING (g) GROUP BY g"""
_SHOWN = ["mean_min", "mean_median", "mean_max", "std_min", "std_median", "std_max", "dead", "global_mean", "global_std"]


_ROWS = f"""SELECT count(*) AS rows, round(avg(l2), 6) AS l2_mean, round(stddev_pop(l2), 6) AS l2_std, round(min(lo), 6) AS low, round(max(hi), 6) AS high, round(avg(cv), 6) AS frame_cv FROM (
 SELECT vec_id, sqrt(sum(e)) AS l2, min(lo) AS lo, max(hi) AS hi, stddev_pop(sqrt(e)) / avg(sqrt(e)) AS cv FROM (
  SELECT vec_id, pos % 8 AS f, sum(v * v) AS e, min(v) AS lo, max(v) AS hi FROM {LONG} GROUP BY vec_id, pos % 8) GROUP BY vec_id)"""


@query("a8_column_profile", f"SELECT * FROM ({_PROFILE.format(key='0', long=LONG, out='')}) CROSS JOIN ({_ROWS})")
def a8(spark, sf_dir):
    shown = [*_SHOWN, "rows", "l2_mean", "l2_std", "low", "high", "frame_cv"]
    p = stats.column_profile(vectors(spark, sf_dir), frames=8)
    return _round(p.select(*shown), *(c for c in shown if c not in ("dead", "rows")))


@query("a9_batch_moments", f"SELECT label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM {LONG} GROUP BY label")
def a9(spark, sf_dir):
    return _round(stats.finalise(moments.whole(_by_label(spark, sf_dir), ["label"])).select("label", "n", "mean", "std"), "mean", "std")


@query("a10_band_profiles", _PROFILE.format(key="CAST(pos // 16 AS INTEGER)", long=LONG, out="g AS band,"))
def a10(spark, sf_dir):
    p = stats.column_profile(vectors(spark, sf_dir), bands=16)
    return _round(p.select("band", *_SHOWN), *(c for c in _SHOWN if c != "dead"))


_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a11_metric_means", " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 5) AS mean, round(stddev_samp({m}), 5) AS std FROM lineitem" for m in _METRICS))
def a11(spark, sf_dir):
    return _round(scoring.column_means(table(spark, sf_dir, "lineitem"), _METRICS), "mean", "std", digits=5)


@query("a12_distance_summary", f"""
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(quantile_cont(d, 0.25), 6) AS p25,
 round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75, round(max(d), 6) AS max FROM (SELECT 1 - list_cosine_similarity(pred, target) AS d FROM {PAIRS})""")
def a12(spark, sf_dir):
    s = stats.distance_summary(pairs(spark, sf_dir).select((1 - A.cosine("pred", "target")).alias("d")), "d")
    return _round(s, *(c for c in s.columns if c != "n"))


@query("a13_position_mse", f"SELECT pos, round(avg((p - t) * (p - t)), 6) AS mse FROM {_LONGSQ} GROUP BY pos")
def a13(spark, sf_dir):
    return _round(scoring.per_position_mse(pairs(spark, sf_dir)), "mse")


def spans(spark):
    return spark.createDataFrame([("gain", 0, 16), ("cutoff", 16, 40), ("shape", 40, 64)], "name string, lo int, hi int")


_NAME = "CASE WHEN pos < 16 THEN 'gain' WHEN pos < 40 THEN 'cutoff' ELSE 'shape' END"


@query("a14_parameter_mse", f"""
SELECT {_NAME} AS name, round(avg(m), 6) AS mse FROM (SELECT pos, avg(m) AS m FROM (SELECT label, pos, avg((p - t) * (p - t)) AS m FROM {_LONGSQ} GROUP BY label, pos) GROUP BY pos) GROUP BY 1""")
def a14(spark, sf_dir):
    return _round(scoring.per_parameter_mse(pairs(spark, sf_dir), "label", spans(spark)), "mse")


_SWAP = """
WITH a AS (SELECT vec_id, {g} AS g, p, row_number() OVER (PARTITION BY vec_id, {g} ORDER BY p, pos) AS r FROM {long}),
b AS (SELECT vec_id, {g} AS g, pos, t, row_number() OVER (PARTITION BY vec_id, {g} ORDER BY t, pos) AS r FROM {long})
SELECT pos, round(avg((p - t) * (p - t)), 6) AS mse FROM a JOIN b USING (vec_id, g, r) GROUP BY pos"""


@query("a15_best_swap", _SWAP.format(g="0", long=_LONGSQ))
def a15(spark, sf_dir):
    return _round(scoring.best_swap(pairs(spark, sf_dir)), "mse")


@query("a16_weighted_swap", f"SELECT round(sum(mse * n) / sum(n), 6) AS mse FROM (SELECT mse, 1 AS n FROM ({_SWAP.format(g='0', long=_LONGSQ).replace('round(avg((p - t) * (p - t)), 6)', 'avg((p - t) * (p - t))')}))")
def a16(spark, sf_dir):
    return metrics.evaluate(pairs(spark, sf_dir), {"swap": metrics.SwapError()}).select(S.rounded("value", 6).alias("mse"))


@query("a17_group_swap", _SWAP.format(g="pos % 8", long=_LONGSQ))
def a17(spark, sf_dir):
    return _round(scoring.group_swap(pairs(spark, sf_dir), [list(range(g, 64, 8)) for g in range(8)]), "mse")


_BLOCKS = f"""
WITH RECURSIVE c AS (
 SELECT vec_id, pos // 16 AS g, a.b AS i, pos % 16 // 4 AS j, pos, (p[pos // 16 * 16 + a.b * 4 + pos % 4 + 1] - t) * (p[pos // 16 * 16 + a.b * 4 + pos % 4 + 1] - t) AS e
 FROM (SELECT vec_id, pred AS p, unnest(range(64)) AS pos, unnest(target) AS t FROM {PAIRS}), range(4) a(b)),
k AS MATERIALIZED (SELECT vec_id, g, i, j, sum(e) AS cost FROM c GROUP BY ALL),
o AS (SELECT vec_id, g, 0 AS n, []::BIGINT[] AS js, 0.0::DOUBLE AS cost FROM (SELECT DISTINCT vec_id, g FROM k)
 UNION ALL SELECT o.vec_id, o.g, n + 1, list_append(js, j), o.cost + k.cost FROM o JOIN k ON k.vec_id = o.vec_id AND k.g = o.g AND k.i = o.n AND NOT list_contains(js, k.j) WHERE n < 4),
w AS (SELECT vec_id, g, arg_min(js, cost) AS js FROM o WHERE n = 4 GROUP BY ALL)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(e), 6) AS mse FROM c JOIN w ON c.vec_id = w.vec_id AND c.g = w.g AND js[c.i + 1] = c.j GROUP BY pos"""


@query("a17_block_swap", _BLOCKS)
def a17_blocks(spark, sf_dir):
    groups = [[[g * 16 + b * 4 + i for i in range(4)] for b in range(4)] for g in range(4)]
    return _round(scoring.block_swap(pairs(spark, sf_dir), groups), "mse")


@query("a18_number_groups", r"SELECT regexp_replace(p_brand, '[\s_.-]*\d+[\s_.-]*', '#', 'g') AS grp, count(DISTINCT p_brand) AS names, count(*) AS rows FROM part GROUP BY 1")
def a18(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(S.number_group(F.col("p_brand")).alias("grp")).agg(F.countDistinct("p_brand").alias("names"), F.count("*").alias("rows"))


@query("a19_weighted_group_swap", f"SELECT round(sum(m * n) / sum(n), 6) AS mse FROM (SELECT mse AS m, 1 AS n FROM ({_SWAP.format(g='pos % 8', long=_LONGSQ).replace('round(avg((p - t) * (p - t)), 6)', 'avg((p - t) * (p - t))')}))")
def a19(spark, sf_dir):
    swap = metrics.SwapError(tuple(tuple(range(g, 64, 8)) for g in range(8)))
    return metrics.evaluate(pairs(spark, sf_dir), {"swap": swap}).select(S.rounded("value", 6).alias("mse"))


@query("a22_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a23_sum_rejections", "SELECT count(*) FILTER (event_type = 'error') AS clipped, count(*) FILTER (value < 1) AS silent FROM events")
def a23(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("clipped"), F.count_if(F.col("value") < 1).alias("silent"))


@query("a24_run_summary", """
SELECT count(*) FILTER (event_type <> 'error') AS rendered, count(*) FILTER (event_type = 'error') AS skipped, count(*) AS total,
 date_diff('second', min(ts), max(ts)) AS seconds, round(count(*) FILTER (event_type <> 'error') / date_diff('second', min(ts), max(ts))::DOUBLE, 6) AS rate FROM events""")
def a24(spark, sf_dir):
    done = F.count_if(F.col("event_type") != "error")
    seconds = _seconds(F.max("ts")) - _seconds(F.min("ts"))
    return table(spark, sf_dir, "events").agg(
        done.alias("rendered"), F.count_if(F.col("event_type") == "error").alias("skipped"), F.count("*").alias("total"), seconds.alias("seconds"),
        S.rounded(F.coalesce(F.try_divide(done, seconds), F.lit(0.0)), 6).alias("rate"),
    )


@query("a25_effect_ranking", """
SELECT l_shipmode, CAST(row_number() OVER (ORDER BY d DESC, l_shipmode) AS INTEGER) AS rank, round(d, 5) AS distance FROM (
 SELECT l_returnflag || l_linestatus AS l_shipmode, avg(l_extendedprice * l_discount) AS d FROM lineitem GROUP BY 1)""")
def a25(spark, sf_dir):
    from pyspark.sql import Window

    key = F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")
    d = table(spark, sf_dir, "lineitem").groupBy(key).agg(F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    return d.select("l_shipmode", F.row_number().over(Window.orderBy(F.desc("d"), "l_shipmode")).alias("rank"), S.rounded("d", 5).alias("distance"))


@query("a26_value_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a26(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("user_id")


@query("a27_bucket_means", """
SELECT CAST(b AS INTEGER) AS bucket, coalesce(round(avg(l_extendedprice), 4), 'nan'::DOUBLE) AS mean FROM range(8) t(b)
LEFT JOIN (SELECT least(greatest(floor(l_discount * 8), 0), 7) AS k, l_extendedprice FROM lineitem) ON k = b GROUP BY b""")
def a27(spark, sf_dir):
    return _round(scoring.bucket_means(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount", 8), "mean", digits=4)


@query("a28_loss_band", """
SELECT CAST(ts AS DATE) AS day, round(avg(value), 5) AS mean, round(avg(value) - 2 * stddev_samp(value), 5) AS low, round(avg(value) + 2 * stddev_samp(value), 5) AS high FROM events GROUP BY 1""")
def a28(spark, sf_dir):
    m, s = F.avg("value"), F.stddev_samp("value")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        S.rounded(m, 5).alias("mean"), S.rounded(m - 2 * s, 5).alias("low"), S.rounded(m + 2 * s, 5).alias("high")
    )


@query("a29_worst_by_pair", """
SELECT l_returnflag, l_linestatus, max(l_discount) AS worst_distance, min(l_tax) AS worst_similarity FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a29(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.max("l_discount").alias("worst_distance"), F.min("l_tax").alias("worst_similarity"))


@query("a30_duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def a30(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@query("a31_distinct_vectors", f"SELECT count(*) AS rows, count(DISTINCT list_transform(v, lambda x: round(x, 6))) AS different FROM {_E}")
def a31(spark, sf_dir):
    # 128 bits of each rounded vector
    rounded = F.transform("v", lambda x: F.round(x, 6) + 0.0)
    key = F.struct(F.xxhash64(rounded), F.xxhash64(rounded, F.lit(1)))
    return vectors(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("different"))


@query("a32_oracle_zero", f"""
SELECT label, round(sum(e), 6) AS total, sum(e) = 0 AS passed FROM (SELECT label, list_sum(list_transform(v, lambda x: CASE WHEN vec_id % 50 = 7 AND abs(x) > 0.3 THEN x * x / 4 ELSE 0 END)) AS e FROM {_E}) GROUP BY label""")
def a32(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    # an oracle's predictions, some of which a clipped copy spoils: the gate passes only where the total is exactly 0
    spoilt = F.transform("v", lambda x: F.when((F.col("vec_id") % 50 == 7) & (F.abs(x) > 0.3), x / 2).otherwise(x))
    e = rows.select("label", A.total(A.squared_error("v", spoilt)).alias("e")).groupBy("label").agg(F.sum("e").alias("total"))
    return e.select("label", S.rounded("total", 6).alias("total"), (F.col("total") == 0).alias("passed"))


@query("a33_slot_cosine", f"""
WITH s AS (SELECT vec_id, unnest(range(8)) AS i, unnest(list_transform(range(8), lambda i: v[i * 8 + 1:i * 8 + 8])) AS x FROM {_E})
SELECT a.vec_id, round(avg(list_cosine_similarity(a.x, b.x)), 6) AS cosine FROM s a JOIN s b USING (vec_id) WHERE a.i <> b.i GROUP BY a.vec_id""")
def a33(spark, sf_dir):
    unit = F.transform(A.bands("v", 8), lambda s: F.transform(s, lambda x: x / A.norm(s)))
    u = vectors(spark, sf_dir).select("vec_id", unit.alias("u"))
    summed = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: A.total(F.transform("u", lambda s: F.get(s, j))))
    own = A.total(F.transform("u", lambda s: A.dot(s, s)))
    return u.select("vec_id", S.rounded((A.dot(summed, summed) - own) / 56, 6).alias("cosine"))


@query("a34_run_identity", """
WITH d AS (SELECT DISTINCT l_returnflag, l_orderkey || ':' || l_linenumber || ':' || l_linestatus AS k FROM lineitem),
m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)),
z AS (SELECT CASE WHEN n <= 256 THEN 0 WHEN n <= 4096 THEN 1 WHEN n <= 65536 THEN 2 WHEN n <= 1048576 THEN 3 WHEN n <= 16777216 THEN 4 ELSE 5 END AS depth FROM m),
n5 AS (SELECT l_returnflag AS g, substr(md5(k), 1, depth) AS p, sha256(string_agg(len(k) || ':' || k, '|' ORDER BY k)) AS x FROM d, z GROUP BY 1, 2),
""" + ",\n".join(f"""n{i - 1} AS (SELECT g, substr(p, 1, {i - 1}) AS p, sha256(string_agg(x, '|' ORDER BY p)) AS x FROM n{i} WHERE len(p) = {i} GROUP BY 1, 2 UNION ALL SELECT * FROM n{i} WHERE len(p) < {i})""" for i in range(5, 0, -1)) + """
SELECT g AS l_returnflag, x AS identity FROM n0""")
def a34(spark, sf_dir):
    k = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_linestatus")
    return scoring.identity_digest(table(spark, sf_dir, "lineitem").select("l_returnflag", k.alias("k")), "l_returnflag", "k")


@query("a34_first_difference", """
SELECT l_returnflag, min(substr(md5(l_orderkey || ':' || l_linenumber), 1, depth)) AS prefix FROM lineitem,
 (SELECT CASE WHEN max(n) <= 256 THEN 0 WHEN max(n) <= 4096 THEN 1 WHEN max(n) <= 65536 THEN 2 WHEN max(n) <= 1048576 THEN 3 WHEN max(n) <= 16777216 THEN 4 ELSE 5 END AS depth
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag))
WHERE l_orderkey % 97 = 5 GROUP BY l_returnflag""")
def a34_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("k"))
    whole = scoring.digest_tree(rows, "l_returnflag", "k")
    depth = whole.agg(F.max(F.length("prefix"))).first()[0] or 0
    # another run that lost some orders
    return scoring.first_differences(whole, scoring.digest_tree(rows.where("l_orderkey % 97 <> 5"), "l_returnflag", "k", depth=depth), "l_returnflag")


@query("a35_stored_counts", """
SELECT shard, n AS found, 1000 AS expected FROM (SELECT o_orderkey // 1000 AS shard, count(*) AS n FROM orders GROUP BY 1) WHERE n <> 1000""")
def a35(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("shard")).agg(F.count("*").alias("found"))
    return n.where("found <> 1000").select("shard", "found", F.lit(1000).alias("expected"))


@query("a36_likely_categories", """
SELECT name, n, CASE WHEN n = 2 THEN 'likely binary' WHEN n BETWEEN 3 AND 16 THEN 'likely categorical' END AS flag FROM (
 SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS name,
 unnest([count(DISTINCT l_quantity), count(DISTINCT l_discount), count(DISTINCT l_tax), count(DISTINCT l_linenumber)]) AS n FROM lineitem)""")
def a36(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    long = table(spark, sf_dir, "lineitem").select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names))))
    n = long.distinct().groupBy("name").agg(F.count("v").alias("n"))
    return n.select("name", "n", F.when(F.col("n") == 2, "likely binary").when(F.col("n").between(3, 16), "likely categorical").alias("flag"))


@query("a37_shard_metrics", """
SELECT user_id AS shard, CAST(sum(len(props)) AS BIGINT) AS bytes, date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) AS seconds, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY user_id""")
def a37(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("shard")).agg(
        F.sum(F.octet_length("props")).alias("bytes"), (_seconds(F.max("ts")) - _seconds(F.min("ts"))).alias("seconds"),
        F.count_if(F.col("event_type") == "error").alias("rejected"),
    )
