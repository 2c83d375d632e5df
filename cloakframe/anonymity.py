"""Equivalence classes and the k level. Rows with a null in the columns form no class, unless nulls='group'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import q


def equivalence_classes(df: DataFrame, qids: list[str] | None = None, nulls: str = "drop") -> DataFrame:
    """The columns and `count`; without qids all columns count."""
    cols = list(qids or df.columns)
    source = df.dropna(subset=[q(c) for c in cols]) if nulls == "drop" else df
    return source.groupBy(*[F.col(q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("count"))


def violations(df: DataFrame, k: int = 2, qids: list[str] | None = None, nulls: str = "drop") -> DataFrame:
    """Classes of fewer than k rows."""
    return equivalence_classes(df, qids, nulls).filter(F.col("count") < k)


def k_level(df: DataFrame, qids: list[str] | None = None, nulls: str = "drop") -> DataFrame:
    """k_level: the smallest class; null without classes."""
    return equivalence_classes(df, qids, nulls).agg(F.min("count").alias("k_level"))


def is_k_anonymous(df: DataFrame, k: int = 2, qids: list[str] | None = None, nulls: str = "drop") -> DataFrame:
    """is_k_anonymous: whether the smallest class has k rows; false without classes."""
    return k_level(df, qids, nulls).select(F.coalesce(F.col("k_level") >= k, F.lit(False)).alias("is_k_anonymous"))
