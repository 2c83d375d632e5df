"""The exact clusterers on tables of any size; cells against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import cluster
from cloakframe.operators.cluster import Block, Clusterer
from cloakframe.spec import AnonSpec

METHODS = ["k_member", "oka"]


def scan(self, low, exact):
    rows = np.sort(np.concatenate(self.rows))
    return int(rows[exact(rows).argmin()])


def block(n, seed, missing):
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.exponential(size=n), 2), rng.integers(0, 9, n).astype(float)
    span = float(np.ptp(x))
    x[rng.random(n) < missing] = np.nan
    leaf = rng.integers(0, 90, n)
    return Block([None, x, y], [np.stack([leaf, leaf // 7, leaf * 0], 1), None, None], [0.0, span, 8.0])


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("missing", [0, 0.05, 1])
def test_cells_find_what_a_scan_finds(method, missing, monkeypatch):
    b = block(700, 3, missing)
    got = cluster.KERNELS[method](b, 4, 5)
    monkeypatch.setattr(cluster.Cells, "least", scan)
    want = cluster.KERNELS[method](b, 4, 5)
    assert got[0] == want[0] and repr(got[1]) == repr(want[1])


@pytest.mark.parametrize("method", METHODS)
def test_exact_form_has_no_limit(spark, method):
    n = 20_001
    df = spark.range(n).select("id", (F.col("id") * 7919 % 10007).alias("x"))
    got = Clusterer(AnonSpec(df, ("x",), {"x": False}, None, "id"), 4, method, seed=1).assign()
    assert got.select("key").distinct().count() == n
    assert got.groupBy("group_id").count().agg(F.min("count"), F.sum("count")).first()[:] == (4, n)
