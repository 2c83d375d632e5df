"""How models are fitted."""

import pytest
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from cloakframe import mleval


@pytest.mark.parametrize(("cells", "parts"), [(500_000, 1), (60, 3)])
def test_linear_svm_passes_over_gathered_rows(spark, monkeypatch, cells, parts):
    seen, fit = [], OneVsRest.fit
    monkeypatch.setattr(mleval, "CELLS", cells, raising=False)
    monkeypatch.setattr(OneVsRest, "fit", lambda self, df: (seen.append((df.storageLevel.useMemory, df.rdd.getNumPartitions(), df.count())), fit(self, df))[1])
    df = spark.range(120).select("id", (F.col("id") % 2).cast("string").alias("t"), (F.col("id") % 2 * 10 + F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = mleval.Evaluation("SVM", df.repartition(40), ["x", "y"], "t", "id", 0.25).evaluate()
    assert seen == [(True, parts, 90)] and got["metrics"].first()["accuracy"] == 1.0
