"""Array states of wide vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators import moments, stats
from rowforge.plans import catalog
from rowforge.streaming import incremental
from tests.compare import SMALL


def by_pos(df):
    return {r.pos: r for r in df.collect()}


def test_a_hundred_thousand_positions(spark):
    width = 100_000
    rows = spark.range(0, 24, 1, 4).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i * F.col("id") % 7 + 1e6).cast("double")).alias("v"))
    state = moments.merged(moments.states(rows, []), [])
    sizes = [(r.block, len(r.n)) for r in state.collect()]
    assert sorted(sizes) == [(b, min(moments.BLOCK, width - b * moments.BLOCK)) for b in range(-(-width // moments.BLOCK))]
    done = stats.finalise(moments.by_position(state, []))
    assert "Generate" not in done._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([[(i * k) % 7 + 1e6 for i in range(0, width, 997)] for k in range(24)])
    got = by_pos(done.where("pos % 997 = 0"))
    assert [got[p].mean for p in range(0, width, 997)] == pytest.approx(x.mean(axis=0), rel=1e-14)
    assert [got[p].std for p in range(0, width, 997)] == pytest.approx(x.std(axis=0), rel=1e-9)
    one = moments.whole(state, []).first()
    full = np.array([[(i * k) % 7 + 1e6 for i in range(width)] for k in range(24)])
    assert (one.n, one.mean, one.low, one.high) == (full.size, pytest.approx(full.mean()), 1e6, 1e6 + 6) and np.sqrt(one.m2 / one.n) == pytest.approx(full.std(), rel=1e-9)


def test_nulls_nans_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, None, nan, 2.0]), ("a", [3.0, 5.0, 1.0]), ("a", None), ("a", []), (None, [7.0]), ("b", [None, None]), ("b", [inf])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    got = {(r.k, r.pos): (r.n, r.mean, r.m2, r.low, r.high) for r in moments.by_position(moments.merged(moments.states(df, ["k"]), ["k"]), ["k"]).collect()}
    assert got[("a", 0)] == (2, 2.0, 2.0, 1.0, 3.0) and got[("a", 1)] == (1, 5.0, 0.0, 5.0, 5.0) and got[("a", 3)] == (1, 2.0, 0.0, 2.0, 2.0)
    n, mean, _, low, high = got[("a", 2)]
    assert n == 2 and np.isnan(mean) and low == 1.0 and np.isnan(high)
    assert got[(None, 0)] == (1, 7.0, 0.0, 7.0, 7.0) and got[("b", 1)] == (0, None, None, None, None) and got[("b", 0)][:2] == (1, inf)
    assert moments.merged(moments.states(df.limit(0), ["k"]), ["k"]).count() == 0


@pytest.mark.parametrize("fan", [1, 64])
def test_states_merge_in_any_order(spark, monkeypatch, fan):
    monkeypatch.setattr(moments, "HELD", 100)  # passed on after almost every batch
    x = np.random.default_rng(4).normal(size=(300, 5)) + 1e7
    df = spark.createDataFrame([(i % 3, [float(c) for c in r]) for i, r in enumerate(x)], "k int, v array<double>").repartition(7)
    fine = moments.merged(moments.states(df, ["k"]), ["k"], fan=fan)
    got = by_pos(stats.finalise(moments.by_position(moments.merged(fine, [], fan=fan), [])))
    assert [got[p].std for p in range(5)] == pytest.approx(x.std(axis=0), rel=1e-9) and [got[p].n for p in range(5)] == [300] * 5


def test_profiles_of_bands_and_groups(spark):
    x = np.random.default_rng(5).normal(size=(40, 10))
    df = spark.createDataFrame([(i % 2, [float(c) for c in r]) for i, r in enumerate(x)], "g int, v array<double>")
    for r in stats.column_profile(df, keys=["g"], bands=4).collect():
        part = x[r.g :: 2, r.band * 4 : r.band * 4 + 4]
        norms = np.linalg.norm(part, axis=1)
        assert (r.rows, r.l2_mean, r.l2_std) == (20, pytest.approx(norms.mean()), pytest.approx(norms.std()))
        assert (r.global_mean, r.global_std, r.low, r.high) == tuple(map(pytest.approx, (part.mean(), part.std(), part.min(), part.max())))
        assert (r.mean_min, r.std_median, r.dead) == (pytest.approx(part.mean(axis=0).min()), pytest.approx(np.median(part.std(axis=0))), 0)
    assert stats.column_profile(df, keys=["g"], bands=4).count() == 6
    assert stats.column_profile(df.limit(0)).count() == 0 and stats.column_profile(df.limit(0), keys=["g"]).count() == 0


@pytest.mark.parametrize("name", [n for n in catalog.load()[0] if n.split("_")[0] in {"a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "a10", "t5", "s11", "s13", "p19"}])
def test_no_row_for_each_component(spark, name):
    plan = catalog.load()[0][name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_a_repeated_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "vec_id long, v array<double>")
    write = incremental.merge_batch(str(tmp_path / "s"), [])
    for batch in (0, 1, 1):
        write(df, batch)
    assert incremental.merged_state(spark, str(tmp_path / "s"), []).first()["n"] == 4
