"""Queries: sources and sinks, vector index, incremental jobs, Arrow functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import arrays as A
from rowforge.functions import scalars as S
from rowforge.operators import derived, index, matching, metrics, moments, production, ranking, scoring, stats
from rowforge.plans.predicates import vectors
from rowforge.plans.registry import LONG, PAIRS, query
from rowforge.plans.scalar_queries import pairs
from rowforge.sources import signal_folder, snapshots, tables
from rowforge.session import table
from rowforge.streaming import incremental, ledger

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("s1_open_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1(spark, sf_dir):
    return tables.open_table(spark, f"{sf_dir}/nation.parquet")


@query("s2_projected_scan", f"SELECT list_transform(v, lambda x: round(x, 6)) AS v FROM {_E}")
def s2(spark, sf_dir):
    return tables.column(spark, f"{sf_dir}/embeddings.parquet", "embedding").select(F.transform("embedding", lambda x: S.rounded(x.cast("double"), 6)).alias("v"))


@query("s3_subfields", "SELECT CAST(props->>'$.k' AS BIGINT) AS param FROM events")
def s3(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.from_json("props", "k long, other string").alias("shift"))
    return tables.fields(rows, {"param": "shift.k"})


@query("s4_discover_shards", "SELECT DISTINCT o_orderkey // 5000 AS shard FROM orders WHERE o_orderkey // 5000 BETWEEN 1 AND 6")
def s4(spark, sf_dir):
    out = tables.scratch(spark)
    tables.publish_shards(table(spark, sf_dir, "orders").withColumn("shard", F.floor(F.col("o_orderkey") / 5000)), out, "shard")
    return tables.shards(spark, out, first=1, last=6).select("shard").distinct()


@query("s5_listing", "SELECT 'nation.parquet' AS name, count(*) AS rows, true AS agrees FROM nation UNION ALL SELECT 'region.parquet', count(*), true FROM region")
def s5(spark, sf_dir):
    found = tables.listing(spark, sf_dir, "{region,nation}.parquet")
    out = None
    for name in ("nation", "region"):
        # what readers say of the file that each row comes from must be what the listing says
        of = table(spark, sf_dir, name).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"))
        counts = of.groupBy("path", "size", "at").agg(F.count("*").alias("rows"))
        out = counts if out is None else out.unionByName(counts)
    bare = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    met = found.select(bare("path").alias("name"), "length", "modificationTime").join(out.select(bare("path").alias("name"), "size", "at", "rows"), "name")
    agrees = (F.col("length") == F.col("size")) & (F.unix_seconds("modificationTime") == F.unix_seconds("at"))
    return met.select("name", "rows", agrees.alias("agrees"))


@query("s6_fit_signals", f"""
SELECT vec_id, flatten(list_transform(range(2), lambda c: list_transform(range(1, 61), lambda i: CASE WHEN i <= 4 THEN 0 ELSE round(v[i - 4] * 0.5, 6) END))) AS signal FROM {_E}""")
def s6(spark, sf_dir):
    fitted = F.transform(A.padded("v", 4, 60), lambda x: S.rounded(x * 0.5, 6))
    return vectors(spark, sf_dir).select("vec_id", A.stereo(fitted).alias("signal"))


@query("s6_signal_folder", f"""
SELECT label || '/' || vec_id || '.f4' AS path, 256 AS length, flatten(list_transform(range(2), lambda c: list_transform(range(1, 61), lambda i: CASE WHEN i <= 4 THEN 0 ELSE round(v[i - 4] * 0.5, 6) END))) AS signal FROM {_E}""")
def s6_folder(spark, sf_dir):
    folder = tables.scratch(spark)
    path = F.concat(F.col("label"), F.lit("/"), F.col("vec_id"), F.lit(".f4"))
    signal_folder.write_signals(vectors(spark, sf_dir).select(path.alias("path"), F.col("v").alias("signal")), folder)
    rows = signal_folder.read_signals(spark, folder, bytesPerTask="100000")
    fitted = F.transform(signal_folder.fitted("signal", left=4, length=60, gain=0.5), lambda x: S.rounded(x, 6))
    return rows.select("path", "length", fitted.alias("signal"))


@query("s7_typed_batches", "SELECT event_id, CAST(value AS FLOAT)::DOUBLE AS value, '{}' AS debug FROM events")
def s7(spark, sf_dir):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.FloatType()), T.StructField("debug", T.StringType())])
    return tables.with_debug(table(spark, sf_dir, "events").select("event_id", "value"), schema).select("event_id", F.col("value").cast("double").alias("value"), "debug")


@query("s8_overwrite", "SELECT o_orderkey, o_totalprice FROM orders")
def s8(spark, sf_dir):
    out = tables.scratch(spark)
    for _ in range(2):
        tables.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), out, rows_per_file=50_000)
    return spark.read.parquet(out)


@query("s9_publish_shards", "SELECT CAST(o_orderkey % 8 AS INTEGER) AS shard, count(*) * CASE WHEN o_orderkey % 8 = 3 THEN 2 ELSE 1 END AS rows FROM orders GROUP BY o_orderkey % 8")
def s9(spark, sf_dir):
    out = tables.scratch(spark)
    rows = table(spark, sf_dir, "orders").withColumn("shard", F.pmod("o_orderkey", F.lit(8)).cast("int"))
    tables.publish_shards(rows, out, "shard", pieces=4)
    again = rows.where("shard = 3")
    tables.publish_shards(again.unionAll(again), out, "shard", pieces=4)  # one shard anew, the others stay
    return spark.read.parquet(out).groupBy("shard").agg(F.count("*").alias("rows"))


@query("s10_publish_splits", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS rows FROM orders GROUP BY 1")
def s10(spark, sf_dir):
    out = tables.scratch(spark)
    rows = table(spark, sf_dir, "orders").withColumn("split", F.when(F.pmod("o_orderkey", F.lit(10)) == 0, "test").otherwise("train"))
    tables.publish_splits(rows, out)
    tables.publish_splits(rows.where("split = 'test'"), out)
    return spark.read.parquet(out).groupBy("split").agg(F.count("*").alias("rows"))


@query("s11_stats_sink", f"SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM {LONG} GROUP BY pos")
def s11(spark, sf_dir):
    out = tables.scratch(spark)
    done = stats.finalise(stats.channel_states(vectors(spark, sf_dir), [])).select("pos", "mean", "std")
    tables.overwrite(done, out)
    return spark.read.parquet(out).select("pos", S.rounded("mean", 6).alias("mean"), S.rounded("std", 6).alias("std"))


@query("s12_audit_card", """
SELECT '{"run":"run-1","shards":' || count(*) || ',"selected":[' || string_agg('{"shard":' || user_id || ',"attempt":' || a || '}', ',' ORDER BY user_id) || ']}' AS card
FROM (SELECT user_id, arg_min(event_id, (ts, event_id)) AS a FROM events GROUP BY user_id)""")
def s12(spark, sf_dir):
    won = ranking.earliest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("shard"), F.col("event_id").alias("attempt"))
    return tables.audit_card(won, "run-1")


@query("s13_checked_stats", f"SELECT label, round(stddev_pop(v), 6) AS std FROM {LONG} GROUP BY label")
def s13(spark, sf_dir):
    state = stats.finalise(moments.whole(moments.merged(moments.states(vectors(spark, sf_dir), ["label"]), ["label"]), ["label"]))
    return tables.checked_stats(state).select("label", S.rounded("std", 6).alias("std"))


@query("s14_metric_csv", f"SELECT vec_id, round(list_cosine_similarity(pred, target), 6) AS cosine FROM {PAIRS}")
def s14(spark, sf_dir):
    out = tables.scratch(spark)
    pairs(spark, sf_dir).select("vec_id", S.rounded(A.cosine("pred", "target"), 6).alias("cosine")).write.csv(out, header=True)
    return spark.read.schema("vec_id long, cosine double").csv(out, header=True)


_M = ["l_discount", "l_tax"]


@query("s15_metric_scalars", " UNION ALL ".join(f"SELECT '{m}_{n}' AS name, round({f}({m}), 6) AS value FROM lineitem" for m in _M for n, f in (("mean", "avg"), ("std", "stddev_samp"))))
def s15(spark, sf_dir):
    return tables.metric_scalars(scoring.column_means(table(spark, sf_dir, "lineitem"), _M)).select("name", S.rounded("value", 6).alias("value"))


@query("s16_metric_json", """SELECT '{"l_linestatus":' || count(DISTINCT l_linestatus) || ',"rows":' || count(*) || '}' AS json FROM lineitem""")
def s16(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct("l_linestatus").alias("l_linestatus"))
    return tables.json_object(n.unpivot([], ["rows", "l_linestatus"], "name", "value"), "name", "value")


@query("s17_comparison_csv", f"SELECT vec_id, label, round(list_cosine_similarity(pred, target), 6) AS cosine FROM {PAIRS}")
def s17(spark, sf_dir):
    out = tables.scratch(spark)
    rows = pairs(spark, sf_dir).select("label", S.rounded(A.cosine("pred", "target"), 6).alias("cosine"), "vec_id")
    rows.select("vec_id", "label", "cosine").write.csv(out, header=True)
    return spark.read.schema("vec_id long, label int, cosine double").csv(out, header=True)


@query("s18_parameter_table", """
SELECT coalesce(p.p_brand, t.p_brand) AS name, p.x AS pred, t.x AS target FROM (SELECT p_brand, max(p_size) AS x FROM part WHERE p_size < 4 GROUP BY 1) p
FULL JOIN (SELECT p_brand, max(p_size) AS x FROM part WHERE p_size > 47 GROUP BY 1) t ON p.p_brand = t.p_brand""")
def s18(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda where, name: p.where(where).groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias(name))
    return one("p_size < 4", "pred").join(one("p_size > 47", "target"), "name", "full").select("name", "pred", "target")


@query("s19_prediction_writer", f"SELECT vec_id // 100 AS batch_idx, count(*) AS rows FROM {PAIRS} GROUP BY 1")
def s19(spark, sf_dir):
    out = tables.scratch(spark)
    pairs(spark, sf_dir).withColumn("batch_idx", F.floor(F.col("vec_id") / 100)).write.partitionBy("batch_idx").parquet(out)
    return spark.read.parquet(out).groupBy(F.col("batch_idx").cast("long").alias("batch_idx")).agg(F.count("*").alias("rows"))


@query("s20_markdown", "SELECT '| label | rows |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || label || ' | ' || count(*) || ' |' FROM embeddings GROUP BY label")
def s20(spark, sf_dir):
    return tables.markdown(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("rows")), ["label", "rows"])


_SUB = "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500"


@query("s21_snapshot", _SUB)
def s21(spark, sf_dir):
    path, _ = snapshots.snapshot(spark, f"{sf_dir}/orders.parquet", tables.scratch(spark), columns=["o_orderkey", "o_orderstatus"], order=["o_orderkey"], limit=500)
    return snapshots.rows(spark, path)


#: A source that grows by the odd keys: what each request for it gives.
_REUSE = """
WITH n AS (SELECT count(*) FILTER (o_orderkey % 2 = 0) AS even, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS s, count(*) AS every, sum(o_totalprice) AS t FROM orders)
SELECT * FROM (SELECT 'first' AS step, even AS rows, round(s, 2) AS total, false AS reused FROM n UNION ALL SELECT 'again', even, round(s, 2), true FROM n
 UNION ALL SELECT 'grown', every, round(t, 2), false FROM n UNION ALL SELECT 'pinned', even, round(s, 2), true FROM n UNION ALL SELECT 'old name', 0, NULL, NULL FROM n)"""


@query("s22_reuse", _REUSE)
def s22(spark, sf_dir):
    root, orders = tables.scratch(spark), table(spark, sf_dir, "orders")
    source, ask = f"{root}/orders", {"columns": ["o_orderkey", "o_totalprice"], "order": ["o_orderkey"]}
    tables.overwrite(orders.where("o_orderkey % 2 = 0"), source)
    pin = snapshots.live_version(spark, source)
    found = {step: snapshots.snapshot(spark, source, f"{root}/cache", **ask) for step in ("first", "again")}
    snapshots.snapshot(spark, source, f"{root}/cache", name="orders", **ask)
    orders.where("o_orderkey % 2 = 1").write.mode("append").parquet(source)
    found["grown"] = snapshots.snapshot(spark, source, f"{root}/cache", **ask)
    found["pinned"] = snapshots.snapshot(spark, source, f"{root}/cache", pin=pin, **ask)
    try:
        found["old name"] = snapshots.snapshot(spark, source, f"{root}/cache", name="orders", **ask)
    except snapshots.SnapshotMismatch:  # made of the version before
        found["old name"] = None
    out = None
    for step, got in found.items():
        kept = snapshots.rows(spark, got[0]) if got else orders.select("o_orderkey", "o_totalprice").limit(0)
        one = kept.agg(F.lit(step).alias("step"), F.count("*").alias("rows"), S.rounded(F.sum("o_totalprice"), 2).alias("total")).withColumn("reused", F.lit(got and got[1]).cast("boolean"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s23_split_snapshots", "SELECT 'even' AS split, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM orders WHERE o_orderkey % 2 = 1")
def s23(spark, sf_dir):
    root, orders = tables.scratch(spark), table(spark, sf_dir, "orders")
    sources = {}
    for name, rest in (("even", 0), ("odd", 1)):
        sources[name] = f"{root}/{name}"
        tables.overwrite(orders.where(F.pmod("o_orderkey", F.lit(2)) == rest), sources[name])
    done = snapshots.materialise_splits(spark, sources, f"{root}/cache", {"even": ["o_orderkey"], "odd": ["o_orderkey", "o_custkey"]}, ["o_orderkey"])
    one = lambda s: snapshots.rows(spark, done[s]).agg(F.lit(s).alias("split"), F.count("*").alias("rows"))
    return one("even").unionByName(one("odd"))


@query("x1_index_build", """
SELECT count(*) AS rows, round(sqrt(count(*))) AS cells, count(DISTINCT vec_id) AS ids, CAST(sum(vec_id) AS BIGINT) AS id_sum, true AS bounded FROM embeddings""")
def x1(spark, sf_dir):
    built = index.build(vectors(spark, sf_dir))
    ids = built.rows.select("n", F.explode("ids").alias("id"))
    counts = [F.count("*").alias("rows"), F.lit(float(built.config.cells)).alias("cells"), F.countDistinct("id").alias("ids"), F.sum("id").alias("id_sum")]
    return ids.agg(*counts, (F.max("n") <= index.PIECE).alias("bounded"))


@query("x2_config_match", "SELECT count(*) AS rows, round(sqrt(count(*))) AS cells, 'cosine' AS metric, true AS reused FROM embeddings UNION ALL SELECT count(*), round(sqrt(count(*))), 'l2', false FROM embeddings")
def x2(spark, sf_dir):
    v, folder = vectors(spark, sf_dir), tables.scratch(spark)
    built = index.build(v)
    index.save(built, folder)
    out = None
    for metric in ("cosine", "l2"):
        config = index.IndexConfig(built.config.cells, metric=metric)
        stored = index.load(spark, folder, config)
        rows = (stored or index.build(v, config)).rows.agg(F.sum("n").alias("rows"), F.lit(float(config.cells)).alias("cells"), F.lit(metric).alias("metric"), F.lit(stored is not None).alias("reused"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _queries(v):
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def _probes(cells):
    return max(1, cells * 3 // 4)


@query("x3_ann_search")
def x3(spark, sf_dir):
    v = vectors(spark, sf_dir)
    built = index.build(v)
    return index.search(built, _queries(v), 5, probes=_probes(built.config.cells)).select("query_id", "rank", "vec_id", S.rounded("score", 6).alias("cosine"))


@query("x3_index_exact", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(c, 6) AS cosine FROM (
 SELECT q.vec_id AS query_id, v.vec_id, c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(c, 12) DESC, v.vec_id) AS rank FROM
  (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, (SELECT list_cosine_similarity(q.e, v.e) AS c)) WHERE rank <= 5""")
def x3_exact(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = index.search(index.build(v), _queries(v), 5, probes=None, refine=None)
    return found.select("query_id", "rank", "vec_id", S.rounded("score", 6).alias("cosine"))


@query("x3_ann_recall", "SELECT true AS enough, 5 * count(*) AS pairs FROM embeddings WHERE vec_id % 20 = 0")
def x3_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    built = index.build(v)
    found = index.search(built, _queries(v), 5, probes=_probes(built.config.cells))
    return index.recall(found, matching.k_nearest(_queries(v), v, 5)).select((F.col("recall") >= 0.9).alias("enough"), "pairs")


#: The fold of each shard's events in order, one event a step.
_FOLD = """
WITH RECURSIVE ev AS MATERIALIZED (
 SELECT user_id AS shard, event_id, CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'claim' END AS action, 'w' || event_id % 2 AS owner, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CASE WHEN event_type = 'purchase' THEN event_id // 2 % 2 + 1 END AS gen, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
st AS (
 SELECT DISTINCT shard, 0::BIGINT AS rn, 0::BIGINT AS event_id, '' AS action, '' AS owner, false AS accepted, 'available' AS status, '' AS holder, 0::BIGINT AS expiry, 0::BIGINT AS attempts, 0::BIGINT AS gen, 0::BIGINT AS sec FROM ev
 UNION ALL
 SELECT shard, rn, event_id, action, owner, ok, CASE WHEN NOT ok THEN status WHEN action = 'claim' THEN 'claimed' ELSE 'done' END, CASE WHEN ok AND action = 'claim' THEN owner ELSE holder END,
  CASE WHEN ok AND action = 'claim' THEN sec + 7200 ELSE expiry END, attempts + CASE WHEN ok AND action = 'claim' THEN 1 ELSE 0 END, gen + CASE WHEN ok AND action = 'claim' THEN 1 ELSE 0 END, sec
 FROM (SELECT ev.shard, ev.rn, ev.event_id, ev.action, ev.owner, ev.sec, st.status, st.holder, st.expiry, st.attempts, st.gen,
   CASE WHEN ev.action = 'claim' THEN st.status = 'available' OR (st.status = 'claimed' AND st.expiry < ev.sec) ELSE st.status = 'claimed' AND st.holder = ev.owner AND st.gen = ev.gen END AS ok
  FROM st JOIN ev ON ev.shard = st.shard AND ev.rn = st.rn + 1))
SELECT {0} FROM st WHERE rn > 0"""
_VERDICT = ["shard", "event_id", "action", "owner", "accepted", "status", "attempts", "gen"]


@query("t1_lease_ledger", _FOLD.format(", ".join(_VERDICT)))
def t1(spark, sf_dir):
    return ledger.replay(ledger.applyable(table(spark, sf_dir, "events"))).select(*_VERDICT)


@query("t1_lease_stream", _FOLD.format(", ".join(_VERDICT)))
def t1_stream(spark, sf_dir):
    return ledger.follow(ledger.applyable(table(spark, sf_dir, "events")), tables.scratch(spark)).select(*_VERDICT)


@query("t1_lease_expiry", f"""
WITH f AS MATERIALIZED (SELECT * FROM ({_FOLD.format("*")})),
a AS (SELECT *, lead(sec) OVER (PARTITION BY shard ORDER BY rn) AS next FROM f WHERE accepted)
SELECT {", ".join(_VERDICT)} FROM f UNION ALL
SELECT shard, NULL, 'expire', holder, true, 'ended', attempts, gen FROM a WHERE action = 'claim' AND expiry < coalesce(next, (SELECT max(sec) FROM f))""")
def t1_expiry(spark, sf_dir):
    return ledger.follow(ledger.applyable(table(spark, sf_dir, "events")), tables.scratch(spark), expiries=True).select(*_VERDICT)


@query("t2_fenced_completion", _FOLD.format("shard, event_id, owner, gen, accepted") + " AND action = 'complete'")
def t2(spark, sf_dir):
    rows = ledger.replay(ledger.applyable(table(spark, sf_dir, "events")))
    return rows.where("action = 'complete'").select("shard", "event_id", "owner", "gen", "accepted")


@query("t3_claimable", """
SELECT event_id FROM events WHERE event_type = 'view' OR (event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)""")
def t3(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "available").when(F.col("event_type") == "click", "claimed").otherwise("done")
    now = ev.agg(F.max("ts").alias("now"))
    rows = ev.crossJoin(F.broadcast(now))
    return rows.where(production.claimable(status, F.col("ts") + F.expr("INTERVAL 2 HOURS"), F.col("now"))).select("event_id")


@query("t4_missing_work", "SELECT DISTINCT user_id AS shard FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def t4(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("shard"), "event_type")
    return incremental.pending(ev.select("shard").distinct(), ev.where("event_type = 'purchase'"), "shard")


@query("t4_completed_once", "SELECT user_id AS shard, 1::BIGINT AS completions FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def t4_stream(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("shard"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    # the second portion comes again, as after a writer's restart
    parts = [done.where(F.pmod("event_id", F.lit(3)) == i) for i in (0, 1, 1, 2)]
    once = incremental.follow_completions(parts, "shard", "ts", tables.scratch(spark))
    return once.groupBy("shard").agg(F.count("*").alias("completions"))


@query("t5_incremental_stats", f"SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM {LONG} GROUP BY pos")
def t5(spark, sf_dir):
    source = tables.scratch(spark)
    vectors(spark, sf_dir).repartition(4, "label").write.parquet(source)
    live = spark.readStream.schema("vec_id long, label int, v array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    state = stats.finalise(incremental.incremental_stats(live))
    return state.select("pos", "n", S.rounded("mean", 6).alias("mean"), S.rounded("std", 6).alias("std"))


@query("t6_progress", "SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY 1")
def t6(spark, sf_dir):
    return incremental.progress(table(spark, sf_dir, "events"))


@query("t6_row_counters", """
SELECT least((i // 1000 + 1) * 1000, n) AS upto, count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS done
FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) GROUP BY 1""")
def t6_rows(spark, sf_dir):
    return incremental.counters_by_rows(table(spark, sf_dir, "events"), "event_id", 1000, F.col("event_type") == "purchase")


@query("t6_observed_progress", """
SELECT form, count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS done, true AS often_enough FROM events, (VALUES ('batch'), ('stream')) f(form) GROUP BY form""")
def t6_observed(spark, sf_dir):
    folder, events, done = tables.scratch(spark), table(spark, sf_dir, "events"), F.col("event_type") == "purchase"
    events.repartitionByRange(6, "event_id").write.parquet(f"{folder}/in")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found, every = [], max(1, events.count() // 4)
    for form, df in (("batch", events), ("stream", live)):
        told = incremental.run_with_progress(df, done, f"{folder}/{form}", rows=every)
        found += [(form, c["rows"], c["done"], len(told) >= (3 if form == "stream" else 1)) for c in told]
    counters = spark.createDataFrame(found, "form string, rows long, done long, often boolean")
    return counters.groupBy("form").agg(F.sum("rows").alias("rows"), F.sum("done").alias("done"), F.bool_and("often").alias("often_enough"))


@query("t7_finalise_once", "SELECT count(*) AS rows, true AS first, false AS second FROM orders")
def t7(spark, sf_dir):
    out = tables.scratch(spark)
    build = lambda: table(spark, sf_dir, "orders")
    first, second = incremental.finalise_once(spark, out, build), incremental.finalise_once(spark, out, build)
    return spark.read.parquet(out).agg(F.count("*").alias("rows"), F.lit(first).alias("first"), F.lit(second).alias("second"))


def _peaks(batch: pa.Table) -> dict[str, pa.Array]:
    flat, parents = pc.list_flatten(batch["v"]).combine_chunks(), pc.list_parent_indices(batch["v"]).combine_chunks()
    top = pa.table({"p": parents, "a": pc.abs(flat)}).group_by("p", use_threads=False).aggregate([("a", "max")])
    return {"peak": top["a_max"]}


@query("g1_batch_udf", f"SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak FROM {_E}")
def g1(spark, sf_dir):
    schema = T.StructType([T.StructField("peak", T.DoubleType())])
    return derived.batch_columns(vectors(spark, sf_dir), _peaks, schema).select("vec_id", S.rounded("peak", 6).alias("peak"))


@query("g2_schema_by_sample", f"SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak FROM {_E}")
def g2(spark, sf_dir):
    return derived.batch_columns(vectors(spark, sf_dir), _peaks).select("vec_id", S.rounded("peak", 6).alias("peak"))


@query("g3_metric_state", f"SELECT label, round(sum(e) / sum(n), 6) AS mse FROM (SELECT label, list_sum(list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS e, 64 AS n FROM {PAIRS}) GROUP BY label")
def g3(spark, sf_dir):
    found = metrics.evaluate(pairs(spark, sf_dir), {"mse": metrics.SquaredError()}, "label")
    return found.select(F.col("key").alias("label"), S.rounded("value", 6).alias("mse"))


@query("g4_struct_scores", f"""
SELECT vec_id, round(list_cosine_similarity(pred, target), 6) AS cosine, round(sqrt(list_sum(list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2 FROM {PAIRS}""")
def g4(spark, sf_dir):
    scores = F.struct(A.cosine("pred", "target").alias("cosine"), matching.euclid("pred", "target").alias("l2"))
    rows = pairs(spark, sf_dir).select("vec_id", scores.alias("s"))
    return rows.select("vec_id", S.rounded("s.cosine", 6).alias("cosine"), S.rounded("s.l2", 6).alias("l2"))


#: Measures of a pair by name, all computed in one pass.
METRICS = {
    "cosine": lambda: A.cosine("pred", "target"),
    "mse": lambda: A.mean(A.squared_error("pred", "target")),
    "swap": lambda: A.mean(A.best_swap_error("pred", "target")),
}


@query("g5_metric_registry", f"""
SELECT vec_id, round(list_cosine_similarity(pred, target), 6) AS cosine, round(list_sum(list_transform(list_zip(pred, target), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64, 6) AS mse,
 round(list_sum(list_transform(list_zip(list_sort(pred), list_sort(target)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64, 6) AS swap FROM {PAIRS}""")
def g5(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", *(S.rounded(build(), 6).alias(name) for name, build in METRICS.items()))
