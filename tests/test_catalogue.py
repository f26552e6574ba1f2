"""A choice of the catalogue's queries against their SQL; the others are compared in the same way at larger scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from thalweg.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
CHOSEN = ["flow_direction", "stream_nodes", "strahler_order", "evaluate_coupling", "evaluate_geometry", "hard_negatives", "stratified_negatives", "roc_auc", "precision_threshold", "line_pixels", "basin_lookup", "elevation_histogram"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET memory_limit = '2GB'")
    for t in ("embeddings", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, expected = catalogue.QUERIES[name](spark, SF), con.sql(catalogue.ORACLE_SQL[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in expected.columns]).collect()]
    assert sorted(got, key=str) == sorted((tuple(plain(v) for v in r) for r in expected.fetchall()), key=str) and got


def test_every_query_has_sql_or_is_beyond_it():
    beyond = set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)
    assert beyond == {"raster_patches", "raster_connectivity", "cnn_embeddings", "boosted_trees", "embeddings_joined"}
