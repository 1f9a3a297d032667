"""Every catalogue query with an oracle must equal DuckDB on sf0.01."""

import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF01
from tests.oracle_check import compare, duck

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, queries()[name], SQL[name], SF01)
    assert r["ok"], r


def test_reduced_variance_equals_numpy(spark):
    x = np.array([r[0] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("embedding").collect()])
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    shares = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = [r["explained_variance_ratio"] for r in queries()["pca_variance"](spark, SF01).orderBy("component").collect()]
    assert np.allclose(got, (shares / shares.sum())[:len(got)], atol=2e-6)


def test_fuzzy_edges_are_undirected_and_complete(spark):
    rows = queries()["fuzzy_edges"](spark, SF01).collect()
    assert all(0 < r["w"] <= 1 and r["a"] < r["b"] for r in rows) and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    # every vector's nearest neighbour has weight 1
    top = {}
    for r in rows:
        for i in (r["a"], r["b"]):
            top[i] = max(top.get(i, 0), r["w"])
    assert len(top) == 500 and min(top.values()) == 1.0
