"""Every registered query with SQL gives the rows that DuckDB gives on the small tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    c = duck.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in c.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(norm(r[cols.index(k)]) for k in order) for r in c.fetchall())
    assert sorted(tuple(norm(r[k]) for k in order) for r in got) == want


def test_queries_without_sql_are_those_that_have_tests_of_their_own():
    plain = {"pagerank_parts", "betweenness_sampled", "louvain", "cluster_names", "clusters", "analytics_nations", "distinct_clusters", "lexical_embedding_blake2b", "lexical_embedding_fnv"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == plain


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["a", "b", "shared", "jaccard"]
