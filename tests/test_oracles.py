"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cloakframe.operators.cluster import Clusterer
from cloakframe.plans.queries import ORACLES, QUERIES, supplier_spec

SLOW = {"ml_linear_svm", "ml_random_forest", "ml_logistic", "ml_decision_tree"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)].map(lambda x: round(x, 5) if isinstance(x, float) else x).astype(str)
    return sorted(map(tuple, pdf.to_numpy()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["kmember_table", "oka_table"])
def test_clusters_have_k_rows(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert got.count() == 10 and min(r["count"] for r in got.groupBy("s_nationkey", "s_acctbal").count().collect()) >= 3


@pytest.mark.parametrize(("name", "method"), [("kmember_table", "k_member"), ("oka_table", "oka")])
def test_clusters_are_exact_at_every_size(spark, tmp_path, name, method):
    rows = spark.range(1600).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "(id * 7919 % 10007) / 7.0D AS s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    want = Clusterer(supplier_spec(spark, str(tmp_path)), 3, method, "summarization", seed=7).transform().df
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
