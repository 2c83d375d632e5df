"""Exact stratified samples and splits. Ranks come from hashes of the row key, so they do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.uniform import uniform
from ..plans.tables import materialize
from ..spec import q

#: A stratum's rows are ranked in so many buckets of their hash, so that no task sorts a whole stratum.
BUCKETS = 256


def _ranked(df: DataFrame, target: str, key: str, seed: int) -> DataFrame:
    """df with _u, _rank (from 1, within the stratum by the hash) and _size; rows without target are dropped."""
    rows = df.filter(F.col(q(target)).isNotNull()).withColumn("_u", uniform(seed, "sample", F.col(q(key)))).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    counts = materialize(rows.groupBy(F.col(q(target)).alias("_t"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n")), "strata")
    whole = W.Window.partitionBy("_t")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(whole.orderBy("_c").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_n").over(whole))
    joined = rows.join(counts.drop("_n"), (F.col(q(target)) == F.col("_t")) & (F.col("_b") == F.col("_c")))
    inside = W.Window.partitionBy("_t", "_b").orderBy("_u", q(key))
    return joined.withColumn("_rank", F.row_number().over(inside) + F.col("_before"))


def stratified_sample(df: DataFrame, target: str, key: str, n: int | None = None, frac: float | None = None, seed: int = 0) -> DataFrame:
    """Of each stratum of `target` its share of rows, rounded half to even; n overrides frac as n over all rows."""
    if n is None and frac is None:
        raise ValueError("give n or frac")
    share = F.lit(frac) if n is None else F.lit(n / max(1, df.count()))
    return _ranked(df, target, key, seed).filter(F.col("_rank") <= F.bround(share * F.col("_size"), 0)).select(*[q(c) for c in df.columns])


def train_test_split(df: DataFrame, target: str, key: str, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """df with a boolean column is_test: the stratified sample of `ratio`."""
    return _ranked(df, target, key, seed).withColumn("is_test", F.col("_rank") <= F.bround(F.lit(ratio) * F.col("_size"), 0)).select(*[q(c) for c in df.columns], "is_test")
