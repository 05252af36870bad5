"""The queries that SQL can express, against their SQL in DuckDB, on the tables and on edge cases."""

import duckdb
import pytest

from lodestar.llm import queries

from .tables import corpus, frame, rows_of

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert rounded(rows_of(got.select(*names))) == rounded(rows) and rows


@pytest.mark.parametrize("name", ["op6_ngram_join", "op7_suffix_dedup", "op8_exact_dedup", "op9_mixing"])
def test_sql_on_edge_cases(spark, tmp_path, name):
    # identifiers are distinct and there: with others SQL counts rows where the operators count texts
    rows = list({r[0]: r for r in corpus() if r[0] is not None}.values())
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rounded(rows_of(got.select(*names))) == rounded(want.fetchall())
