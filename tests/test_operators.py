"""Operators on small frames: edge cases, brute force and round trips."""

import hashlib
import itertools
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import arrays as A
from rowforge.functions import encoding as E
from rowforge.functions import scalars as S
from rowforge.operators import derived, index, matching, metrics, production, ranking, scoring, signals, stats, validation
from rowforge.plans.scalar_queries import spec
from rowforge.sources import signal_folder, snapshots, tables
from rowforge.streaming import incremental, ledger


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>")


def test_merge_keeps_digits_far_from_zero(spark):
    x = [(s, 1e8 + s + i % 3) for s in range(4) for i in range(30)]
    long = spark.createDataFrame(x, "shard long, v double")
    state = stats.finalise(stats.merged(stats.partials(long, ["shard"]).withColumn("k", F.lit(1)), ["k"])).first()
    want = np.array([v for _, v in x])
    assert state["std"] == pytest.approx(want.std(), rel=1e-9) and state["mean"] == pytest.approx(want.mean(), rel=1e-15)


def test_constant_position_is_degenerate_or_masked(spark):
    state = stats.channel_states(vectors(spark, [(i, [1.0] * 25 + [float(i)]) for i in range(4)]), [])
    done = stats.finalise(state)
    r = stats.degenerate(done).first()
    assert (r["n"], r["positions"], r["more"]) == (25, list(range(20)), 5)
    assert stats.finalise(state, mask=True).where("std = 1").count() == 25


def test_one_row_has_no_std(spark):
    assert stats.finalise(stats.channel_states(vectors(spark, [(1, [2.0])]), [])).first()["std"] is None


def test_checked_stats_refuse_zero(spark):
    with pytest.raises(Exception, match="finite and positive"):
        tables.checked_stats(spark.createDataFrame([(1, 0.0)], "pos int, std double")).collect()


def test_not_finite(spark):
    rows = [(1, [1.0, float("nan")]), (2, [float("inf")]), (3, [1.0, None]), (4, []), (5, [0.5])]
    assert sorted(r.vec_id for r in vectors(spark, rows).where(A.any_not_finite("v")).collect()) == [1, 2, 3]


def test_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(A.cosine("a", "b").alias("c")).first().c is None


def test_group_swap_example(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.5], [1.0, 0.0, 1.0])], "vec_id long, pred array<double>, target array<double>")
    assert [r.mse for r in scoring.group_swap(df, [[0, 1], [2]]).orderBy("pos").collect()] == [0.0, 0.0, 0.25]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=6))
def test_best_swap_is_never_above_plain(spark, values):
    p, t = map(list, zip(*values, strict=True))
    df = spark.createDataFrame([(p, t)], "pred array<double>, target array<double>")
    r = df.select(A.total(A.best_swap_error("pred", "target")).alias("s"), A.total(A.squared_error("pred", "target")).alias("e")).first()
    best = min(sum((a - b) ** 2 for a, b in zip(q, t, strict=True)) for q in itertools.permutations(p))
    assert r.s <= r.e + 1e-12 and r.s == pytest.approx(best, abs=1e-12)


def test_block_swap_is_the_best_order_of_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.random(6).tolist(), rng.random(6).tolist()) for _ in range(5)]
    got = {r.pos: r.mse for r in scoring.block_swap(spark.createDataFrame(rows, "pred array<double>, target array<double>"), [[[0, 1], [2, 3], [4, 5]]]).collect()}
    want = np.zeros(6)
    for p, t in rows:
        p, t = np.reshape(p, (3, 2)), np.reshape(t, (3, 2))
        order = min(itertools.permutations(range(3)), key=lambda o: ((p[list(o)] - t) ** 2).sum())
        want += ((p[list(order)] - t) ** 2).ravel() / len(rows)
    assert [got[i] for i in range(6)] == pytest.approx(want.tolist())


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        for _ in range(5):
            c = rng.random((n, n))
            to = matching.assignment(c)
            assert sorted(to) == list(range(n))
            assert c[np.arange(n), to].sum() == pytest.approx(min(c[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n))))


def test_sinkhorn_columns_sum_to_one(spark):
    costs = spark.createDataFrame([(1, i, j, float((i - j) ** 2)) for i in range(4) for j in range(4)], "g int, i int, j int, cost double")
    sums = matching.sinkhorn(costs, 20, 1.0).groupBy("j").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_balanced_ranges_are_ntiles(spark):
    for n, w in ((10, 3), (7, 7), (5, 8), (160, 9)):
        got = [r.w for r in spark.range(n).select(ranking.balanced(F.col("id"), F.lit(n), w).alias("w")).collect()]
        q, r = divmod(n, w)
        assert sorted(got) == [k for k in range(w) for _ in range(q + (k < r))]


@pytest.mark.parametrize(("rows", "size"), [(1, 1), (6, 1), (6, 4), (6, 5), (6, 6), (6, 8)])
def test_batches_at_their_bounds(spark, rows, size):
    df = spark.range(rows).withColumnRenamed("id", "k")
    assert ranking.batches(df, "k", size).count() == rows // size * size
    assert ranking.batches(df, "k", size, drop_last=False).count() == rows


def test_winner_ties_go_to_the_key(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 1, "c")], "shard int, mtime int, key string")
    assert sorted(r.key for r in ranking.earliest(df, "shard", ["mtime", "key"]).collect()) == ["a", "c"]
    assert sorted(r.key for r in ranking.earliest(df, "shard", ["mtime", "key"], F.col("key") == "b").collect()) == ["b", "c"]


def test_first_accepted(spark):
    rows = [(1, 0, "clipped"), (1, 1, None), (1, 2, "silent"), (2, 0, "silent"), (2, 1, "silent")]
    got = {r.s: r for r in ranking.first_accepted(spark.createDataFrame(rows, "s int, a int, r string"), "s", "a", "r", ["clipped", "silent"]).collect()}
    assert (got[1].accepted, got[1].rejected_clipped, got[1].rejected_silent) == (1, 1, 0)
    assert (got[2].accepted, got[2].rejected_silent, got[2].problem) == (None, 2, "none accepted") and got[1].problem is None
    one = {r.s: r for r in ranking.first_accepted(spark.createDataFrame(rows, "s int, a int, r string"), "s", "a", "r", ["clipped"], budget=1).collect()}
    assert (one[1].accepted, one[1].problem, one[1].rejected_clipped) == (None, "budget used up", 1)


def test_winners_keep_the_record_and_name_what_is_lost(spark):
    df = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (2, "c", 1, False), (2, "d", 2, True), (3, "e", 1, False)], "k int, n string, t int, ok boolean")
    recorded = spark.createDataFrame([(1, "b"), (2, "c")], "k int, n string")
    got = {r.k: (r.winner, r.unhealthy, r.problem) for r in ranking.winners(df, "k", "n", ["t"], F.col("ok"), recorded).collect()}
    assert got == {1: ("b", 0, None), 2: ("d", 1, None), 3: (None, 1, "no healthy candidate")}


def test_positions_of_sparse_and_of_repeated_keys(spark):
    sparse = spark.range(5000).select(F.xxhash64("id").alias("k"), "id")
    placed = ranking.positions(sparse, "k", per=100)
    got = placed.orderBy("k").select("i").collect()
    assert [r.i for r in got] == list(range(5000)) and placed.columns == ["k", "id", "i"]
    windows = [x for x in placed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "row_number" in x]
    assert len(windows) == 1 and "__b" in windows[0] and "__t" in windows[0]
    ranges = sparse.groupBy("k").count().count()
    assert ranges == 5000  # as many values as rows, but a running sum over some 50 ranges only
    hot = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    rows = sorted((r.i, r.k) for r in ranking.positions(hot, "k", per=100).collect())
    assert [i for i, _ in rows] == list(range(4000)) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert ranking.positions(sparse.limit(0), "k").count() == 0 and ranking.positions(sparse.limit(1), "k").first().i == 0


def test_strict_statistics_refuse(spark):
    state = spark.createDataFrame([(0, 3, 1.0, 2.0), (1, 3, 1.0, 0.0), (2, 1, 1.0, 0.0)], "pos int, n long, mean double, m2 double")
    assert {r.pos: r.problem for r in stats.refusals(state).collect()} == {1: "no variance", 2: "too few rows"}
    for pos, what in ((1, "no variance"), (2, "too few rows")):
        with pytest.raises(Exception, match=what):
            stats.finalise(state.where(F.col("pos") == pos), strict=True).collect()
    assert stats.finalise(state.where("pos = 0"), strict=True).first()["std"] > 0


def test_quantiles_by_rank_are_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), np.zeros(300)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "d double")
    small = stats.distance_summary(df, "d").first()
    monkeypatch.setattr(stats, "SMALL", 10)
    large = stats.distance_summary(df, "d").first()
    assert [large[c] for c in large.__fields__] == pytest.approx([small[c] for c in small.__fields__])
    assert large["p25"] == pytest.approx(np.quantile(x, 0.25)) and large["n"] == 800


def test_frame_variation_is_nan_for_silent_rows(spark):
    df = vectors(spark, [(1, [3.0, 1.0, 4.0, 1.0]), (2, [0.0] * 4)])
    cv = stats.column_profile(df.where("vec_id = 1"), frames=2).first()["frame_cv"]
    assert cv == pytest.approx(np.std([5, 2**0.5]) / np.mean([5, 2**0.5])) and np.isnan(stats.column_profile(df, frames=2).first()["frame_cv"])


def test_published_shards_leave_others(spark):
    path = tables.scratch(spark)
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("shard"))
    tables.publish_shards(rows, path, "shard", pieces=3)
    tables.publish_shards(rows.where("shard = 2 and id < 50"), path, "shard")
    got = {r.shard: r["count"] for r in spark.read.parquet(path).groupBy("shard").count().collect()}
    assert got == {0: 25, 1: 25, 2: 12, 3: 25}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda key, default: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.scratch(N(conf=conf, sparkContext=N(master="yarn")))


def test_split_problems_are_errors(spark):
    kind = "pos int, split string, shards int, split_seed long"
    assert ranking.shard_table(spark.createDataFrame([(0, "a", 2, 1), (1, "b", 1, 2), (2, "c", 0, None)], kind), 10, 5).count() == 3
    with pytest.raises(ValueError, match="seed is not its own"):
        ranking.shard_table(spark.createDataFrame([(0, "a", 2, 1), (1, "b", 1, 1)], kind), 10, 5)
    with pytest.raises(ValueError, match="all are empty"):
        ranking.shard_table(spark.createDataFrame([(0, "a", 0, None)], kind), 10, 5)
    sizes = spark.createDataFrame([("a", 12, None), ("b", 10, None)], "split string, rows long, split_seed long")
    assert [(r.split, r.problem) for r in ranking.split_problems(sizes, "rows", 4).collect()] == [("b", "size is no multiple")]


def test_probe_refuses_when_a_seed_asks_for_it(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 3, "x"), (2, 4, "y"), (3, 5, "x"), (4, 6, None), (4, 7, None)], "g int, k int, s string")
    p = matching.shuffle_probe(df, "g", "k", "s", 9)
    got = {r.k: (r.partner, r.skipped) for r in p.collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (None, "settings differ"), 4: (None, "settings differ"), 5: (None, "too few rows"), 6: (7, None), 7: (6, None)}
    assert matching.checked_probe(p.where("g = 1")).count() == 2
    with pytest.raises(Exception, match="no shuffle probe"):
        matching.checked_probe(p).collect()


@pytest.mark.parametrize("block", [3, 2048])
def test_worst_pairs_are_the_worst(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(40, 5)).round(2)
    x[7] = x[3]
    df = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], "k long, g int, v array<double>")
    for r in scoring.worst_pairs(df, "g", "k", block=block).collect():
        pairs = list(itertools.combinations([i for i in range(40) if i % 3 == r.g], 2))
        far = {p: round(float(np.linalg.norm(x[p[0]] - x[p[1]])), 6) for p in pairs}
        cos = {p: round(float(x[p[0]] @ x[p[1]] / np.linalg.norm(x[p[0]]) / np.linalg.norm(x[p[1]])), 6) for p in pairs}
        assert (r.far, (r.far_a, r.far_b)) == (max(far.values()), min(p for p in pairs if far[p] == max(far.values())))
        assert (r.cosine, (r.cosine_a, r.cosine_b)) == (min(cos.values()), min(p for p in pairs if cos[p] == min(cos.values())))


def test_mel_bands_cover_the_range():
    w = signals.mel_bands(512, 20, 16_000)
    assert w.shape == (20, 257) and (w >= 0).all() and (w.sum(axis=0)[2:-2] > 0).all()
    assert signals.scales_at(44_100)[1] == (1102, 441, 64)
    assert signals.hertz(np.array([0.0, 15.0, 42.0])) == pytest.approx([0, 1000, 6400])


def test_uuid5_is_pythons(spark):
    got = spark.createDataFrame([("a",), ("",), ("été",)], "t string").select("t", S.uuid5(F.col("t")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.t)) for r in got)


def test_seed_is_the_first_eight_bytes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42:7:0").digest()[:8], "big")
    assert int(spark.range(1).select(S.sha_seed(F.lit(42), F.lit(7), F.lit(0)).alias("s")).first().s) == want


def test_encode_then_decode(spark):
    rows = [(1, "p_size", "17"), (1, "p_retailprice", "1234.5"), (1, "p_group", "3"), (2, "p_size", "50"), (2, "p_retailprice", "900.0"), (2, "p_group", "0")]
    long = spark.createDataFrame(rows, "id long, name string, value string")
    back = E.decode(E.encode(long, spec(spark)), spec(spark)).collect()
    assert {(r.id, r.name, r.value) for r in back} == set(rows)


def test_schema_differences_and_paths(spark):
    a = spark.createDataFrame([], T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StructType([T.StructField("z", T.LongType())]))]))
    assert validation.field_at(a.schema, "y.z").dataType == T.LongType()
    with pytest.raises(KeyError):
        validation.field_at(a.schema, "y.q")
    assert validation.flattened(a).columns == ["x", "y.z"]
    assert validation.schema_differences(a, a).count() == 0
    with pytest.raises(ValueError, match="x"):
        validation.refuse_existing(a, ["x"])


def test_derived_columns_keep_their_identity(spark):
    df = derived.add_columns(vectors(spark, [(1, [3.0, 4.0])]), [derived.REGISTRY["l2"]])
    assert df.first().l2 == 5 and df.schema["l2"].metadata == {derived.IDENTITY: "l2/1"}
    other = derived.Derived("l2", ("v",), "l2/2", A.norm)
    with pytest.raises(ValueError, match="l2/1"):
        derived.missing(df, [other])
    both = [derived.REGISTRY["l2"], derived.REGISTRY["avg"]]
    with pytest.raises(ValueError, match="only a part is there: l2"):
        derived.missing(df, both)
    plain = df.select("vec_id", "v", F.col("l2").alias("l2", metadata={}))
    with pytest.warns(UserWarning, match="l2"):
        assert derived.missing(plain, both[:1]) == []
    assert derived.missing(df, both[1:]) == both[1:] and derived.missing(df, both[:1]) == []


def test_snapshot_is_reused_and_damage_is_an_error(spark):
    root = tables.scratch(spark)
    src = f"{root}/src"
    spark.range(10).write.parquet(src)
    ask = {"columns": ["id"], "order": ["id"], "limit": 3}
    path, reused = snapshots.snapshot(spark, src, root, **ask)
    assert not reused and [r.id for r in snapshots.rows(spark, path).collect()] == [0, 1, 2]
    assert snapshots.snapshot(spark, src, root, **ask) == (path, True)
    assert snapshots.snapshot(spark, src, root, **(ask | {"limit": 4}))[1] is False
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)
    with pytest.raises(snapshots.SnapshotMismatch):
        snapshots.snapshot(spark, src, root, **ask)
    assert not [r.path for r in tables.listing(spark, root).collect() if "_staged" in r.path]


def test_a_changed_source_never_gives_old_rows(spark):
    root = tables.scratch(spark)
    src, cache = f"{root}/src", f"{root}/cache"
    spark.range(10).write.parquet(src)
    ask = {"columns": ["id"], "order": ["id"]}
    pin = snapshots.live_version(spark, src)
    old, _ = snapshots.snapshot(spark, src, cache, **ask)
    named, _ = snapshots.snapshot(spark, src, cache, name="mine", **ask)
    assert snapshots.snapshot(spark, src, cache, name="mine", **ask) == (named, True)
    spark.range(10, 12).write.mode("append").parquet(src)
    assert snapshots.live_version(spark, src) != pin
    new, reused = snapshots.snapshot(spark, src, cache, **ask)
    assert new != old and not reused and snapshots.rows(spark, new).count() == 12
    with pytest.raises(snapshots.SnapshotMismatch, match="version"):
        snapshots.snapshot(spark, src, cache, name="mine", **ask)
    assert snapshots.snapshot(spark, src, cache, pin=pin, **ask) == (old, True)
    gone = spark._jvm.org.apache.hadoop.fs.Path(src)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    assert snapshots.snapshot(spark, src, cache, pin=pin, **ask) == (old, True)  # no look at the source
    spark.range(10).write.parquet(src)
    with pytest.raises(snapshots.SnapshotMismatch, match="not at"):
        snapshots.snapshot(spark, src, cache, pin="0" * 64, **ask)
    spark.range(3).write.mode("append").parquet(f"{old}/rows")
    with pytest.raises(snapshots.SnapshotMismatch, match="other files"):
        snapshots.snapshot(spark, src, cache, pin=pin, **ask)


def test_results_are_put_in_place_whole(spark):
    path = tables.scratch(spark)
    spark.range(3).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)  # an unfinished one
    seen = []

    def build():
        seen.append(spark.read.parquet(path).count())
        return spark.range(5)

    assert incremental.finalise_once(spark, path, build) and spark.read.parquet(path).count() == 5
    assert not incremental.finalise_once(spark, path, build) and seen == [3]

    def late():
        assert incremental.finalise_once(spark, f"{path}-2", lambda: spark.range(7))
        return spark.range(9)

    assert not incremental.finalise_once(spark, f"{path}-2", late) and spark.read.parquet(f"{path}-2").count() == 7


def test_a_large_batch_is_paired_in_little_memory():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(600, 64)), rng.normal(size=(600, 64))
    cost = matching.distances(a, b)
    assert cost == pytest.approx(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)))
    to = matching.assignment(cost)
    assert sorted(to) == list(range(600))
    # no exchange of two partners, and no circle of three, is cheaper
    own = cost[np.arange(600), to]
    swap = cost[:, to]
    assert (swap + swap.T >= own[:, None] + own[None, :] - 1e-9).all()


def test_pairing_takes_the_distance_not_its_square(spark):
    rows = [("b", 0, [0.0, 0.0], [1.0, 0.0]), ("b", 1, [1.0, 0.0], [2.0, 0.2]), (None, 5, [0.0], [1.0])]
    df = spark.createDataFrame(rows, "batch string, k long, l array<double>, r array<double>")
    got = {(r.batch, r.k): (r.paired, r.distance) for r in matching.pair_batches(df, "batch", "k", "l", "r").collect()}
    # 2.01 crosswise against 2.02 straight; the squares are 4.04 against 2.04
    assert [got[("b", i)][0] for i in (0, 1)] == [1, 0] and got[("b", 0)][1] + got[("b", 1)][1] == pytest.approx(4.04**0.5)
    assert got[(None, 5)] == (5, 1.0)


@pytest.mark.parametrize("seed", [0, 1, 42])
def test_permutations_leave_none_in_place(seed):
    for n in range(2, 101):
        i = np.arange(n)
        p = matching.permuted(i, np.full(n, n), np.full(n, seed))
        assert sorted(p) == list(i) and (matching.permuted(p, np.full(n, n), np.full(n, seed), back=True) == i).all()
        q = matching.partner_places(i, np.full(n, n), np.full(n, seed))
        assert sorted(q) == list(i) and not (q == i).any()
    assert matching.partner_places(np.array([0]), np.array([1]), np.array([seed])).tolist() == [0]


def test_a_permutation_of_ten_million():
    n = 10_000_000
    q = matching.partner_places(np.arange(n), np.broadcast_to(np.int64(n), n), np.broadcast_to(np.int64(7), n))
    seen = np.zeros(n, dtype=bool)
    seen[q] = True
    assert seen.all() and not (q == np.arange(n)).any()


def test_places_in_groups_are_gapless(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 50 > 0, F.col("id") % 11).alias("g"), "id", F.lit("x").alias("s"))
    got = {}
    for r in matching.group_positions(df, "g", "id", 3, per=100).collect():
        got.setdefault((r.g, r["__n"]), []).append(r["__i"])
    assert all(sorted(v) == list(range(n)) for (_, n), v in got.items()) and sum(map(len, got.values())) == 5000
    probe = matching.shuffle_probe(df, "g", "id", "s", 5).collect()
    for g in {r.g for r in probe}:
        rows = [(r.id, r.partner) for r in probe if r.g == g]
        assert sorted(a for a, _ in rows) == sorted(b for _, b in rows) and all(a != b for a, b in rows)


def test_digest_trees_name_the_first_difference(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("k"))
    tree = scoring.digest_tree(df.repartition(5), "g", "k", leaf=20)
    again = scoring.digest_tree(df.unionByName(df).orderBy(F.desc("k")), "g", "k", leaf=20, depth=2)
    assert scoring.first_differences(tree, again, "g").count() == 0
    assert tree.groupBy("g", F.length("prefix")).count().agg(F.max("count")).first()[0] == 256
    other = scoring.digest_tree(df.where("k not in ('17', '23')"), "g", "k", depth=2)
    want = min(hashlib.md5(k.encode()).hexdigest()[:2] for k in ("17", "23"))
    assert [tuple(r) for r in scoring.first_differences(tree, other, "g").collect()] == [(1, want)]
    assert scoring.identity_digest(df.limit(0), "g", "k").count() == 0


def test_progress_counts_by_rows_and_by_time():
    from types import SimpleNamespace as N

    now, told = [0.0], []
    p = incremental.RowProgress("x", rows=100, seconds=30, emit=told.append, clock=lambda: now[0])

    def batch(i, rows, done=0):
        p.onQueryProgress(N(progress=N(batchId=i, observedMetrics={"x": {"rows": rows, "done": done}})))

    batch(0, 60, 1)
    batch(1, 60, 2)  # 100 are full
    batch(1, 60, 2)  # told again
    batch(2, 10)
    now[0] = 31
    batch(3, 10)  # late
    p.onQueryProgress(N(progress=N(batchId=4, observedMetrics={})))
    batch(5, 500)
    batch(6, 20, 1)
    now[0] = 90
    p.onQueryIdle(None)
    batch(7, 5)
    p.onQueryTerminated(None)
    assert [(c["kind"], c["rows"], c["processed"]) for c in p.counters] == [("rows", 120, 120), ("time", 20, 140), ("rows", 500, 640), ("time", 20, 660), ("end", 5, 665)]
    assert told == p.counters and sum(c["done"] for c in told) == 4


def test_index_finds_rows_themselves_first(spark):
    rng = np.random.default_rng(1)
    v = vectors(spark, [(i, rng.normal(size=32).tolist()) for i in range(300)])
    built = index.build(v)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = index.search(built, q, 5, probes=built.config.cells)
    assert found.where("rank = 1 and query_id <> vec_id").count() == 0
    assert index.recall(found, matching.k_nearest(q, v, 5)).first().recall >= 0.9
    assert index.build(v.where("vec_id < 10")) is None
    folder = tables.scratch(spark)
    assert index.load(spark, folder, built.config) is None
    index.save(built, folder)
    again = index.load(spark, folder, built.config)
    assert sorted(map(tuple, index.search(again, q, 3).collect())) == sorted(map(tuple, index.search(built, q, 3).collect()))
    assert index.load(spark, folder, index.IndexConfig(built.config.cells, metric="dot")) is None
    with pytest.raises(ValueError, match="metric"):
        index.IndexConfig(4, metric="other")


@pytest.mark.parametrize("few", [0, 4096])
@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_index_ranks_by_its_metric(spark, monkeypatch, metric, few):
    monkeypatch.setattr(index, "FEW", few)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) * rng.uniform(0.2, 3, (300, 1))
    v = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    built = index.build(v, index.IndexConfig(8, parts=4, metric=metric))
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for r in index.search(built, q, 3, probes=8, refine=100).collect():
        score = x[r.query_id] @ x.T if metric == "dot" else -((x[r.query_id] - x) ** 2).sum(axis=1)
        assert r.vec_id == np.argsort(-score)[r["rank"] - 1] and r.score == pytest.approx(np.sort(score)[-r["rank"]])


@pytest.mark.parametrize("few", [0, 4096])
def test_index_stops_at_cells_that_hold_nothing_better(spark, monkeypatch, few):
    monkeypatch.setattr(index, "PIECE", 20)
    monkeypatch.setattr(index, "FEW", few)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(24, 16)) * 4
    x = np.concatenate([centers[np.arange(1200) % 24] + rng.normal(size=(1200, 16)) * 0.1, np.repeat(centers[:1], 90, axis=0)])
    v = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    built = index.build(v, index.IndexConfig(24, parts=4, metric="l2"))
    sizes = [r.n for r in built.rows.select("n").collect()]
    assert max(sizes) <= 20 and sum(sizes) == 1290
    q = v.where("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = index.search(built, q, 5, probes=6).collect()  # a quarter of the cells
    score = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    exact = {(i, r) for i in range(0, 1290, 60) for r in np.round(np.sort(score[i])[-5:], 6)}
    assert len({(r.query_id, round(r.score, 6)) for r in found} & exact) >= 0.9 * len(exact)
    ask = index.search(built, q, 5, probes=None, refine=None)
    assert {(r.query_id, round(r.score, 6)) for r in ask.collect()} == exact


def test_index_bounds_hold(spark):
    rng = np.random.default_rng(2)
    q, x, c = rng.normal(size=(5, 4)), rng.normal(size=(50, 4)), rng.normal(size=(1, 4))
    gap = np.linalg.norm(x - c, axis=1)
    for metric, score in (("l2", -((q[:, None] - x[None]) ** 2).sum(axis=2)), ("dot", q @ x.T)):
        most = index._most(metric, q, q @ c.T, (c**2).sum(axis=1), gap.min(), gap.max())
        assert (score.max(axis=1) <= most[:, 0] + 1e-9).all()


def test_exact_search_keeps_no_candidates(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 16))
    v = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    built = index.build(v)
    monkeypatch.setattr(index, "FEW", 0)
    monkeypatch.setattr(index, "kept", None)  # where candidates of all pairs were written
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = index.search(built, q, 5, probes=None, refine=None)
    assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == {(r.query_id, r["rank"], r.vec_id) for r in matching.k_nearest(q, v, 5).collect()}


def test_codes_rank_rows_of_a_piece_not_of_the_table(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1200, 32))
    v = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    monkeypatch.setattr(index, "FEW", 0)
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = index.search(index.build(v), q, 5, probes=None, refine=1)
    assert index.recall(found, matching.k_nearest(q, v, 5)).first().recall >= 0.9


def test_a_few_events_need_no_table_and_no_folder(monkeypatch):
    f = ledger.pd.DataFrame({"event_id": [3, 1, 2, 4], "action": ["claim", "claim", "complete", "claim"], "owner": ["a", "b", None, "c"], "at": [5.0, 5.0, 1.0, None], "gen": [None, None, 1.0, None]})
    monkeypatch.setattr(ledger, "FEW", 0, raising=False)
    by_runs = list(ledger.in_order([f[:2], f[2:]]))
    monkeypatch.setattr(ledger, "FEW", 2000, raising=False)
    monkeypatch.setattr(ledger.tempfile, "TemporaryDirectory", None)
    monkeypatch.setattr(ledger.pa, "table", None)
    assert list(ledger.in_order([f[:2], f[2:]])) == by_runs
    assert [e.event_id for e in by_runs] == [2, 1, 3, 4] and by_runs[0] == (2, "complete", None, 1, 1)
    assert list(ledger.in_order([])) == []


def test_scores_and_cells_are_made_in_tiles(monkeypatch):
    rng, sizes = np.random.default_rng(6), []
    q, x = rng.normal(size=(600, 4)), rng.normal(size=(9000, 4)).round(1)
    x[8000:8100] = x[0]
    monkeypatch.setattr(index, "_nearness", lambda *a, made=index._nearness: sizes.append(len(a[0]) * len(a[1])) or made(*a))
    assert (index._cells(x, q) == (2 * x @ q.T - (q**2).sum(axis=1)).argmax(axis=1)).all()
    best, add = matching.Best(600, 5), matching.Best.add
    monkeypatch.setattr(matching.Best, "add", lambda self, queries, scores, ids: sizes.append(scores.size) or add(self, queries, scores, ids))
    matching._compare(best, q, np.arange(9000), x)
    assert max(sizes) <= matching.TILE
    scores = np.round(q @ x.T, 12)
    assert (best.ids == np.array([np.lexsort((np.arange(9000), -s))[:5] for s in scores])).all()


def test_nearest_by_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).round(1)
    x[50:60] = x[0]
    v = vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    q = v.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    one, many = matching.k_nearest(q, v, 4), matching.k_nearest(q, v, 4, block=7, chunk=33)
    got = {(r.query_id, r["rank"], r.vec_id) for r in one.collect()}
    assert got == {(r.query_id, r["rank"], r.vec_id) for r in many.collect()} and len(got) == 160
    assert [r.vec_id for r in one.where("query_id = 0").orderBy("rank").collect()] == [0, 50, 51, 52]


def test_equal_signals_score_zero(spark):
    x = np.sin(np.arange(64)).tolist()
    df = spark.createDataFrame([(1, 0, x, x)], "vec_id long, label int, pred array<double>, target array<double>")
    assert signals.spectral_transport(df, 16, 8).first().sot == 0
    assert signals.multi_scale(df, ((8, 4, 4),)).first().mss == 0
    both = {"lsd": metrics.LogSpectral(), "l1": metrics.SpectralL1()}
    assert {r.metric: (r.value, r.updates) for r in metrics.over_updates(df, both, "label").collect()} == {"lsd": (0.0, 1), "l1": (0.0, 1)}


def test_windows_are_cut_to_whole_samples():
    assert signals.scales_at(11_025) == ((110, 55, 32), (275, 110, 64), (1102, 551, 128))


def test_metric_states_merge_in_any_order(spark):
    rng = np.random.default_rng(6)
    p, t = rng.normal(size=(2, 90, 6))
    rows = [(int(i % 4) if i % 4 else None, p[i].tolist(), t[i].tolist()) for i in range(90)]
    df = spark.createDataFrame([*rows, (1, None, [1.0]), (1, [], [])], "k int, pred array<double>, target array<double>").repartition(5)
    found = {"mse": metrics.SquaredError(), "swap": metrics.SwapError(), "pairs": metrics.SwapError(((0, 3), (1, 4)))}
    got = {(r.key, r.metric): r.value for r in metrics.evaluate(df, found, "k").collect()}
    assert len(got) == 12
    for k in (None, 1, 2, 3):
        at = [i for i in range(90) if (i % 4 or None) == k]
        assert got[(k, "mse")] == pytest.approx(((p[at] - t[at]) ** 2).mean())
        assert got[(k, "swap")] == pytest.approx(((np.sort(p[at]) - np.sort(t[at])) ** 2).mean())
        two = [(np.sort(p[at][:, g]) - np.sort(t[at][:, g])) ** 2 for g in ([0, 3], [1, 4])]
        assert got[(k, "pairs")] == pytest.approx(np.mean(two))
    whole = {r.metric: r.value for r in metrics.evaluate(df, found).collect()}
    assert whole["mse"] == pytest.approx(((p - t) ** 2).mean())
    assert metrics.evaluate(df.limit(0), found).count() == 0 and np.isnan(metrics.SquaredError().compute(metrics.SquaredError().zero()))


def test_a_folder_of_signals(spark):
    folder = tables.scratch(spark)
    rows = [(f"{i % 3}/{i}.f8", [float(i), 0.1, -1.0] * i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "path string, signal array<double>")
    assert signal_folder.write_signals(df, folder, kind="f8") == 19
    assert signal_folder.write_signals(df.limit(1), f"{folder}-other", kind="f4") == 1
    got = signal_folder.read_signals(spark, folder, suffix=".f8", kind="f8", bytesPerTask="900")
    back = {r.path: (r.length, r.signal) for r in got.collect()}
    assert back == {p: (8 * len(s), s) for p, s in rows}
    assert got.rdd.getNumPartitions() > 3
    assert signal_folder.read_signals(spark, folder, suffix=".wav").count() == 0
    with pytest.raises(Exception, match="whole number"):
        signal_folder.read_signals(spark, f"{folder}-other", suffix=".f8", kind="f8").collect()
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "s array<double>").select(signal_folder.fitted("s", left=1, length=3, gain=2.0).alias("x")).first().x
    assert one == [0.0, 2.0, 4.0] * 2


LOG = [
    (1, 0, "claim", "a", 0, None), (2, 0, "claim", "b", 10, None), (3, 0, "claim", "b", 8000, None), (4, 0, "complete", "a", 8001, 1),
    (5, 0, "complete", "b", 8002, 1), (6, 0, "complete", "b", 8003, 2), (7, 0, "claim", "a", 99999, None),
]
EVENTS = "event_id long, shard long, action string, owner string, at long, gen long"


def test_lease_rules(spark):
    got = [r.accepted for r in ledger.replay(spark.createDataFrame(LOG, EVENTS)).orderBy("event_id").collect()]
    assert got == [True, False, True, False, False, True, False]
    # the owner claims again: what it finished under its first lease comes too late, and without a generation nothing is accepted
    twice = [(1, 0, "claim", "a", 0, None), (2, 0, "claim", "a", 8000, None), (3, 0, "complete", "a", 8001, 1), (4, 0, "complete", "a", 8002, None), (5, 0, "complete", "a", 8003, 2)]
    assert [r.accepted for r in ledger.replay(spark.createDataFrame(twice, EVENTS)).orderBy("event_id").collect()] == [True, True, False, False, True]
    now = F.lit(10)
    df = spark.createDataFrame([("available", 0), ("claimed", 9), ("claimed", 10), ("done", 0)], "s string, e long")
    assert [r.c for r in df.select(production.claimable(F.col("s"), F.col("e"), now).alias("c")).collect()] == [True, True, False, False]


def test_lease_stream_equals_batch(spark):
    events = ledger.applyable(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    late = spark.createDataFrame(LOG, EVENTS)
    for df in (events, late):
        got = sorted(map(tuple, ledger.follow(df, tables.scratch(spark)).collect()))
        assert got == sorted(map(tuple, ledger.replay(df).collect())) and got


def test_a_lease_that_ends_tells_once(spark):
    one = [(1, 0, "claim", "a", 0, None), (2, 1, "claim", "x", 5, None), (3, 1, "complete", "x", 20, 1), (4, 2, "claim", "y", 90_000, None), (5, 3, "claim", "z", 0, None), (6, 3, "complete", "z", 8000, 1)]
    for rows, want in ((LOG, [(0, "a", 1)]), (one, [(0, "a", 1), (3, "z", 1)])):
        events = spark.createDataFrame(rows, EVENTS).withColumn("at", F.col("at") + 1_000_000)  # a stream's event time begins after 0
        got = ledger.follow(events, tables.scratch(spark), expiries=True)
        assert sorted((r.shard, r.owner, r.gen) for r in got.where("action = 'expire'").collect()) == want
        plain = ledger.replay(events)
        assert sorted(map(str, got.where("action <> 'expire'").collect())) == sorted(map(str, plain.collect()))


def test_lease_tasks_hold_batches_not_shards(spark, monkeypatch):
    import pandas as pd

    # one hot shard with more events than a batch: no operator that gathers a group in a frame, same verdicts as one fold
    events = spark.range(0, 30_000).selectExpr(
        "id AS event_id", "if(id % 3 = 0, id % 5, 7L) AS shard", "if(id % 4 = 3, 'complete', 'claim') AS action", "concat('w', id % 6) AS owner",
        "(id * 7919) % 30011 * 50 AS at", "CAST(NULL AS LONG) AS gen",
    )
    replayed = ledger.replay(events)
    plan = replayed._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    rows = events.toPandas().sort_values(["shard", "at", "event_id"])
    want = [x for key, f in rows.groupby("shard") for x in ledger.apply_events(ledger.Ledger(), key, f.itertuples())]
    assert sorted(map(tuple, replayed.collect())) == sorted(want)
    one = rows[rows["shard"] == 7].sample(frac=1, random_state=1)
    largest, concat = [], pd.concat
    monkeypatch.setattr(ledger.pd, "concat", lambda x: (largest.append(sum(map(len, x))), concat(x))[1])
    got = [e.event_id for e in ledger.in_order((one[i : i + 300] for i in range(0, len(one), 300)), 1000)]
    assert got == rows[rows["shard"] == 7]["event_id"].tolist() and max(largest) <= 1300 < len(one)


def test_progress_is_a_stream_too(spark):
    import datetime as dt

    root = tables.scratch(spark)
    at = dt.datetime(2026, 1, 1)
    rows = [(at + dt.timedelta(minutes=20 * i), "purchase" if i % 2 else "view") for i in range(12)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{root}/in")
    live = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{root}/in")
    q = incremental.progress(live, late="10 minutes").writeStream.format("memory").queryName("progress_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start, r.n, r.done) for r in spark.table("progress_rows").collect()}
    want = {(r.start, r.n, r.done) for r in incremental.progress(spark.read.parquet(f"{root}/in")).collect()}
    assert got <= want and len(got) >= 3
