import duckdb
import pytest

from rowforge.plans import catalog
from tests.compare import connect
from tests.test_rounding import signed

QUERIES, ORACLES = catalog.load()
X = "CAST((i * 37 % 64 - 30) / 64.0 AS FLOAT)"
#: A whole vector, none, an empty, a short, a single and a long one, null components, not-finite ones, zeros of both signs.
VECTORS = [
    f"list_transform(range(64), lambda i: {X})", "NULL", "[]", f"list_transform(range(32), lambda i: {X})", "[0.25]", f"list_transform(range(70), lambda i: {X})",
    f"list_transform(range(64), lambda i: CASE WHEN i % 9 = 3 THEN NULL ELSE {X} END)", f"list_transform(range(64), lambda i: CASE WHEN i // 8 = 2 THEN NULL ELSE {X} END)",
    "list_transform(range(64), lambda i: NULL)", f"list_transform(range(64), lambda i: CASE WHEN i = 7 THEN 'nan' WHEN i = 40 THEN '-inf' ELSE {X} END)",
    "list_transform(range(64), lambda i: -0.0)", "list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN '-0.0' ELSE '0.0' END)",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS vec_id, CAST({v} AS FLOAT[]) AS embedding, CAST({i % 10} AS INTEGER) AS label" for i, v in enumerate(VECTORS))
    duckdb.sql(f"COPY ({rows}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["p24_stack_children", "p7_mean_pool", "p8_downmix"])
def test_odd_vectors_give_what_sql_gives(spark, odd, name):
    df = QUERIES[name](spark, odd)
    ours = sorted(repr(signed(tuple(r[c] for c in sorted(df.columns)))) for r in df.collect())
    found = connect(odd).execute(ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = sorted(repr(signed(tuple(r[names.index(c)] for c in sorted(names)))) for r in found.fetchall())
    assert len(ours) == len(VECTORS) and ours == theirs


def test_argsort_puts_nulls_last_as_sql_does(spark, tmp_path):
    """Of few components, where DuckDB's sort keeps equal ones in order."""
    lists = ["[3, NULL, 1, CAST('nan' AS FLOAT), 2, NULL]", "[NULL, 0.5]", "[NULL, NULL]", "[]", "NULL", "[CAST('inf' AS FLOAT), CAST('-inf' AS FLOAT), NULL]", "[2, 1, 2, 1]"]
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS vec_id, CAST({v} AS FLOAT[]) AS embedding, CAST(1 AS INTEGER) AS label" for i, v in enumerate(lists))
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    ours = {r["vec_id"]: r["keys"] for r in QUERIES["w13_sort_by_argsort"](spark, str(tmp_path)).collect()}
    assert ours == dict(connect(str(tmp_path)).execute(ORACLES["w13_sort_by_argsort"]).fetchall())
