"""Every catalogue query with SQL agrees with DuckDB; those without run and are held against plain definitions below or in the other tests."""

import os

import duckdb
import pytest

from lodestar.plans import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.execute(catalog.ORACLE_SQL[name])
    have = [c[0] for c in rel.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("rest", [6, 11, 32, 63, 64, 65])
def test_thresholds_where_the_last_shard_is_small(spark, tmp_path, rest):
    import numpy as np

    r = np.random.default_rng(rest)
    # the last shard is nearer to all than the others, so that its norm decides who is in the pool
    rows = [(i, (r.standard_normal(64) * (0.2 if i >= 375 else 0.3)).tolist(), i % 3) for i in range(375 + rest)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        c.execute("CREATE TABLE events (event_id BIGINT, event_type VARCHAR, user_id BIGINT, ts TIMESTAMP, value DOUBLE)")
        for name in ("shard_threshold", "search_global"):
            df = catalog.QUERIES[name](spark, str(tmp_path))
            rel = c.execute(catalog.ORACLE_SQL[name])
            at = [[x[0] for x in rel.description].index(k) for k in df.columns]
            assert sorted(tuple(map(plain, x)) for x in df.collect()) == sorted(tuple(plain(x[i]) for i in at) for x in rel.fetchall()), name


def test_no_row_at_a_time_udfs(spark):
    for name in catalog.QUERIES:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan, name


def test_top_k_is_cut_before_the_shuffle(spark):
    from lodestar.operators import search
    from lodestar.plans.views import Views

    v = Views(spark, SF)
    plan = catalog.QUERIES["knn_exact"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = search.candidates(v.partition, v.queries(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_identities_are_computed_once(spark):
    for name in ("doc_dedup_gate", "ingest_outcome"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "documents.parquet" not in plan, name
