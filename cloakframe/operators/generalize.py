"""Full-domain generalization: one column to a level, and the Datafly algorithm."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ANY
from ..hierarchy import Hierarchy
from ..spec import AnonSpec, q

#: A mapping table of up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


class NotSatisfiable(ValueError):
    """No generalization of the table satisfies k."""


def generalize_column(df: DataFrame, column: str, hierarchy: Hierarchy, level_from: int, level_to: int) -> DataFrame:
    """df with `column` taken from one level of its hierarchy to a higher one, as text.

    Rules are plain expressions. A mapping table is joined on its distinct pairs; a value that it lacks raises an error
    naming the value, a null stays null.
    """
    if not 0 <= level_from < level_to <= hierarchy.height:
        raise ValueError(f"levels {level_from} to {level_to} are not increasing within 0 to {hierarchy.height}")
    if hierarchy.mapping is None:
        return df.withColumn(column, hierarchy.level(F.col(q(column)), level_to, level_from).cast("string"))
    pairs = hierarchy.mapping.select(F.col(f"l{level_from}").cast("string").alias("_from"), F.col(f"l{level_to}").cast("string").alias("_to")).distinct()
    side = F.broadcast(pairs) if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else pairs
    value = F.col(q(column)).cast("string")
    unknown = F.raise_error(F.concat(F.lit(f"{column}: not in its hierarchy: "), value)).cast("string")
    joined = df.join(side, value == F.col("_from"), "left").withColumn(column, F.when(value.isNotNull(), F.coalesce(F.col("_to"), unknown)))
    return joined.select(*[F.col(q(c)) for c in df.columns])


def is_suppressed(hierarchy: Hierarchy, level: int) -> bool:
    """Whether a level is the top, where every value is '*'."""
    return level == hierarchy.height


@dataclass(frozen=True)
class Result:
    """What an anonymizer gives back."""

    df: DataFrame
    levels: dict[str, int] = field(default_factory=dict)  # -1: suppressed
    suppressed: DataFrame | None = None  # classes that were deleted, with their counts
    groups: DataFrame | None = None  # original rows with group_id


def apply_levels(spec: AnonSpec, df: DataFrame, levels: dict[str, int]) -> DataFrame:
    for c, level in levels.items():
        if level > 0:
            df = generalize_column(df, c, spec.hierarchy(c), 0, level)
    return df


@dataclass(frozen=True)
class Datafly:
    """Generalizes the attribute with the most distinct values, until at most `threshold` rows violate k; these go.

    Generalization commutes with counting, so the rows are grouped once; each round works on the distinct
    combinations alone. Ties go to the first quasi-identifier.
    """

    spec: AnonSpec
    k: int
    threshold: int = 0

    def pick(self, row, cols: tuple[str, ...]) -> str:
        return max(cols, key=lambda c: (row[f"d{cols.index(c)}"], -cols.index(c)))

    def transform(self) -> Result:
        cols = self.spec.qids
        base = self.spec.df.groupBy(*[F.col(q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("count")).persist(StorageLevel.DISK_ONLY)
        levels, whole = dict.fromkeys(cols, 0), F.lit(True)
        for c in cols:
            whole = whole & F.col(q(c)).isNotNull()
        try:
            while True:
                now = apply_levels(self.spec, base, levels).groupBy(*[F.col(q(c)) for c in cols]).agg(F.sum("count").alias("count"))
                bad = F.sum(F.when(whole & (F.col("count") < self.k), F.col("count")).otherwise(0))
                row = now.agg(F.count(F.lit(1)).alias("classes"), F.min(F.when(whole, F.col("count"))).alias("least"), bad.alias("bad"), *[F.countDistinct(F.col(q(c))).alias(f"d{i}") for i, c in enumerate(cols)]).first()
                if self.threshold == 0 and row["least"] is not None and row["least"] >= self.k:
                    return self._result(levels, None)
                if row["least"] is not None and row["bad"] <= self.threshold or row["classes"] == 0:
                    return self._result(levels, self.k)
                name = self.pick(row, cols)
                if levels[name] >= self.spec.hierarchy(name).height:
                    if all(row[f"d{i}"] <= 1 for i in range(len(cols))):
                        raise NotSatisfiable(f"no generalization gives classes of {self.k} rows")
                    raise ValueError(f"{name}: its hierarchy has no level above {levels[name]}")
                levels[name] += 1
        finally:
            base.unpersist()

    def _result(self, levels: dict[str, int], below: int | None) -> Result:
        cols = self.spec.qids
        df = apply_levels(self.spec, self.spec.df, levels)
        top = {c: -1 if lv and is_suppressed(self.spec.hierarchy(c), lv) else lv for c, lv in levels.items()}
        if below is None:
            return Result(df, top)
        keys = [F.col(q(c)) for c in cols]
        classes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).dropna(subset=[q(c) for c in cols]).filter(F.col("count") < below)
        on: Column | None = None
        for c in cols:
            same = df[q(c)] == classes[q(c)]
            on = same if on is None else on & same
        return Result(df.join(classes, on, "left_anti"), top, classes)


def levels_table(result: Result, df: DataFrame) -> DataFrame:
    """attribute, level of a result; -1 where the attribute is suppressed."""
    return df.sparkSession.createDataFrame(list(result.levels.items()), "attribute string, level int")


__all__ = ["ANY", "Datafly", "NotSatisfiable", "Result", "apply_levels", "generalize_column", "is_suppressed", "levels_table"]
