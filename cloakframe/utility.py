"""Utility metrics: discernibility, average class size, and the normalized certainty penalty, each as a one-row table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anonymity import equivalence_classes
from .functions.rules import ANY
from .hierarchy import Hierarchy
from .spec import AnonSpec, q


def discernibility(df: DataFrame, qids: list[str], suppressed: int = 0) -> DataFrame:
    return discernibility_of(equivalence_classes(df, qids), suppressed)


def discernibility_of(classes: DataFrame, suppressed: int = 0) -> DataFrame:
    """Sum of squared class sizes, and for each suppressed row the size of the whole table."""
    rows = F.coalesce(F.sum("count"), F.lit(0))
    return classes.agg((F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)) + suppressed * (rows + suppressed)).cast("long").alias("dm"))


def discernibility_best(df: DataFrame, k: int = 1) -> DataFrame:
    n = F.count(F.lit(1))
    more = F.pmod(n, F.lit(k))
    return df.agg(((F.floor(n / k) - more) * k * k + more * (k + 1) * (k + 1)).cast("long").alias("dm_best"))


def average_class(df: DataFrame, qids: list[str], k: int) -> DataFrame:
    return average_class_of(equivalence_classes(df, qids), k)


def average_class_of(classes: DataFrame, k: int) -> DataFrame:
    """Rows for each class, in units of k; null without classes."""
    return classes.agg((F.sum("count") / F.nullif(F.count(F.lit(1)) * k, F.lit(0))).cast("double").alias("cavg"))


def average_class_best(df: DataFrame, k: int = 1) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg((n / F.nullif(F.floor(n / k) * k, F.lit(0))).cast("double").alias("cavg_best"))


def _span(df: DataFrame, cols: list[str]) -> dict[str, float]:
    if not cols:
        return {}
    row = df.agg(*[(F.max(q(c)) - F.min(q(c))).cast("double").alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"s{i}"] or 0.0 for i, c in enumerate(cols)}


def _numeric_penalty(label: Column, span: float) -> Column:
    """Width of a range label over the column's range; other labels cost nothing, a range of zero costs nothing."""
    parts = F.split(label, "~")
    wide = (F.trim(parts[1]).try_cast("double") - F.trim(parts[0]).try_cast("double")) / span if span else F.lit(0.0)
    return F.when(label == ANY, 1.0).when(label.contains("~"), F.coalesce(wide, F.lit(0.0))).otherwise(0.0)


def ncp_generalization(org: AnonSpec, anon: DataFrame) -> DataFrame:
    """Certainty penalty of generalized values, from 0 to 1: rows that were suppressed cost a full penalty.

    A category costs its share of the leaves (a leaf nothing), a range its width, '*' one, a masked number nothing.
    Labels that are no node of their hierarchy raise an error when the result is computed.
    """
    classes = equivalence_classes(anon, list(org.qids))
    spans = _span(org.df, org.qids_numerical)
    total = F.lit(0.0)
    for i, c in enumerate(org.qids):
        label = F.col(q(c)).cast("string")
        if not org.categorical[c]:
            total = total + _numeric_penalty(label, spans[c])
            continue
        h: Hierarchy = org.hierarchy(c)
        leaves = h.leaves(org.df, c).count()
        nodes = h.nodes(org.df, c).select(F.col("node").alias(f"n{i}"), (F.col("leaf_count") / leaves).alias(f"p{i}"))
        classes = classes.join(nodes, label == F.col(f"n{i}"), "left")
        unknown = F.raise_error(F.concat(F.lit(f"{c}: no node of its hierarchy: "), label))
        total = total + F.when(label == ANY, 1.0).otherwise(F.coalesce(F.col(f"p{i}"), unknown.cast("double")))
    n, width = org.df.count(), len(org.qids)
    kept = F.coalesce(F.sum(F.col("count") * total), F.lit(0.0))
    gone = n - F.coalesce(F.sum("count"), F.lit(0))
    return classes.agg(((kept + gone * width) / F.lit(float(width * n) or None)).cast("double").alias("ncp"))


def _groups_ncp(org: AnonSpec, groups: DataFrame, group: str, categorical: dict[str, Column]) -> DataFrame:
    spans = _span(org.df, org.qids_numerical)
    n, width = org.df.count(), len(org.qids)
    numeric = {c: (F.max(q(c)) - F.min(q(c))) / spans[c] if spans[c] else F.lit(0.0) for c in org.qids_numerical}
    each = groups.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *[x.cast("double").alias(f"p{i}") for i, x in enumerate([*numeric.values(), *categorical.values()])])
    penalty = sum((F.col(f"p{i}") for i in range(len(numeric) + len(categorical))), F.lit(0.0))
    gone = n - F.coalesce(F.sum("size"), F.lit(0))
    return each.agg(((F.coalesce(F.sum(F.col("size") * penalty), F.lit(0.0)) + gone * width) / F.lit(float(width * n) or None)).cast("double").alias("ncp"))


def ncp_mean_mode(org: AnonSpec, groups: DataFrame, group: str = "group_id") -> DataFrame:
    """Penalty of mean and mode recoding: ranges of the groups, and the share of rows whose category is not the mode."""
    tops = {}
    for i, c in enumerate(org.qids_categorical):
        top = groups.groupBy(group, F.col(q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.max("n").alias(f"top{i}"), F.sum("n").alias(f"all{i}"))
        groups = groups.join(top, group)
        tops[c] = F.first(1 - F.col(f"top{i}") / F.col(f"all{i}"))
    return _groups_ncp(org, groups, group, tops)


def ncp_summarization(org: AnonSpec, groups: DataFrame, group: str = "group_id") -> DataFrame:
    """Penalty of summarized groups: ranges, and the share of all categories that a group holds."""
    cats = org.qids_categorical
    row = org.df.agg(*[F.countDistinct(q(c)).alias(f"d{i}") for i, c in enumerate(cats)]).first() if cats else {}
    shares = {c: F.countDistinct(q(c)) / F.lit(float(row[f"d{i}"]) or None) for i, c in enumerate(cats)}
    return _groups_ncp(org, groups, group, shares)
