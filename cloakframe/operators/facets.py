"""Looking at a table: facet counts, search, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import q


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, count of every value of the columns; ordering by count descending then value is the reader's choice."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(q(c)).cast("string").alias("value")) for c in columns])).alias("f"))
    return long.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("count"))


def search(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the terms, upper and lower case alike."""
    for c, term in terms.items():
        df = df.filter(F.contains(F.lower(F.col(q(c)).cast("string")), F.lit(term.lower())))
    return df


def page(df: DataFrame, order: list[str], number: int = 0, size: int = 10) -> DataFrame:
    """One page of the table in the given order, which should be unique."""
    return df.orderBy(*[q(c) for c in order]).offset(number * size).limit(size)
