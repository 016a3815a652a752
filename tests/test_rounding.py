import math

import duckdb
import pytest

from rowforge.functions import scalars as S
from rowforge.plans import catalog
from tests.compare import connect

QUERIES, ORACLES = catalog.load()
#: Queries of many small components, by their findings.
NAMES = ["f36_delay", "p22_rescale", "p24_stack_children", "p30_keep_mask", "p7_mean_pool", "p8_downmix", "s2_projected_scan", "w20_fit_frames", "w21_adaptive_pool", "s6_fit_signals", "s6_signal_folder"]


def signed(v):
    """Values with the sign of their zeros."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (math.copysign(1.0, v), round(v, 9))
    return tuple(signed(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Vectors with components that round to zero from both sides."""
    folder = tmp_path_factory.mktemp("small")
    x = "CASE WHEN vec_id = 0 THEN -1e-7 WHEN vec_id = 1 THEN 1e-7 WHEN i % 3 = 0 THEN -1e-7 ELSE (i - 32) / 64.0 END"
    rows = f"SELECT CAST(v AS BIGINT) AS vec_id, list_transform(range(64), lambda i: CAST({x.replace('vec_id', 'v')} AS FLOAT)) AS embedding, CAST(v AS INTEGER) AS label FROM range(4) t(v)"
    duckdb.sql(f"COPY ({rows}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_zeros_have_the_sign_that_sql_gives_them(spark, small, name):
    df = QUERIES[name](spark, small)
    ours = sorted(repr(signed(tuple(r[c] for c in sorted(df.columns)))) for r in df.collect())
    found = connect(small).execute(ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = sorted(repr(signed(tuple(r[names.index(c)] for c in sorted(names)))) for r in found.fetchall())
    assert ours == theirs and "(-1.0, -0.0)" in repr(ours)


def test_rounded_differs_from_round_in_the_sign_of_zeros_alone(spark):
    values = [5e-7, 4.999999999999999e-7, -5e-7, -4.999999999999999e-7, -0.0, 0.0, 1.2345675, -1.2345675, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(S.rounded("x", 6)).collect()]
    assert repr(got) == repr([1e-06, 0.0, -1e-06, -0.0, -0.0, 0.0, 1.234568, -1.234568, float("inf"), float("nan"), None])
