"""Local recoding: every group of rows gets one value per quasi-identifier. Aggregates and one join on the group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import AnonSpec, q

GROUP = "group_id"


def number_text(c: Column, kind: str) -> Column:
    """A number as text: whole numbers plain, doubles with a fraction and, from 1e-4 up to 1e16, without exponent."""
    if kind not in ("double", "float"):
        return c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(c.cast("string").cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16) | (c == 0), digits).otherwise(c.cast("string"))


def _join_back(groups: DataFrame, values: DataFrame, spec: AnonSpec) -> DataFrame:
    """The rows of all groups with their quasi-identifiers replaced by v0, v1, ... of their group."""
    joined = groups.join(values, GROUP)
    places = {c: i for i, c in enumerate(spec.qids)}
    return joined.select(*[F.col(f"v{places[c]}").alias(c) if c in places else F.col(q(c)) for c in groups.columns])


def _kind(spec: AnonSpec, c: str) -> str:
    return dict(spec.df.dtypes)[c]


def summarization(groups: DataFrame, spec: AnonSpec) -> DataFrame:
    """Numbers become 'min ~ max' (one value: itself), categories their sorted set joined by ' & '."""

    def value(c: str) -> Column:
        col = F.col(q(c))
        if spec.categorical[c]:
            return F.array_join(F.array_sort(F.collect_set(col.cast("string"))), " & ")
        lo, hi = (number_text(f(col), _kind(spec, c)) for f in (F.min, F.max))
        return F.when(F.min(col) == F.max(col), lo).otherwise(F.concat(lo, F.lit(" ~ "), hi))

    return _join_back(groups, groups.groupBy(GROUP).agg(*[value(c).alias(f"v{i}") for i, c in enumerate(spec.qids)]), spec)


def mean_mode(groups: DataFrame, spec: AnonSpec, order: str | None = None) -> DataFrame:
    """Numbers become their mean, categories their mode; tied modes: the one that comes first by `order` (the row key)."""
    order = order or spec.order_key
    means = groups.groupBy(GROUP).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(q(c)).alias(f"v{i}") for i, c in enumerate(spec.qids) if not spec.categorical[c]])
    for i, c in enumerate(spec.qids):
        if spec.categorical[c]:
            counts = groups.groupBy(GROUP, F.col(q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(q(order)).alias("first"))
            best = counts.groupBy(GROUP).agg(F.min_by("v", F.struct(-F.col("n"), F.col("first"))).alias(f"v{i}"))
            means = means.join(best, GROUP)
    return _join_back(groups, means.drop("_n"), spec)


def generalization(groups: DataFrame, spec: AnonSpec) -> DataFrame:
    """Every quasi-identifier, numeric ones too, becomes the lowest common ancestor of the group's values.

    Hierarchies are of rules or of mapping tables; a value that a mapping table lacks raises an error.
    """
    values, rows = [], groups
    for i, c in enumerate(spec.qids):
        h, own = spec.hierarchy(c), f"_cf{i}_"
        if h.mapping is None:
            values.append(h.lca(F.col(q(c))).alias(f"v{i}"))
        else:
            rows = h.levels(rows, c, own)
            values.append(h.lca(levels=[F.col(f"{own}{j}") for j in range(h.height + 1)]).alias(f"v{i}"))
    alone = F.raise_error("a group of one row has no common ancestor").cast("boolean")
    found = rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("_n"), *values).filter(F.when(F.col("_n") < 2, alone).otherwise(True))
    return _join_back(groups, found.drop("_n"), spec)


def custom(groups: DataFrame, spec: AnonSpec, recode: Callable, schema: str) -> DataFrame:
    """A user's own function from the pandas rows of one group to their recoded rows; each group must fit in memory."""
    return groups.groupBy(GROUP).applyInPandas(recode, schema)


#: Recoders by name.
RECODERS = {"summarization": summarization, "mean_mode": mean_mode, "generalization": generalization}
