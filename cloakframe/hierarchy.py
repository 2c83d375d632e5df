"""Generalization hierarchies: levels by rules or by a mapping table, and questions about their nodes."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import ANY, Expression, MapValues, Suppress
from .sources.tables import read_mapping


class UnknownNode(ValueError):
    """A value that is no node of the hierarchy."""


@dataclass(frozen=True)
class Hierarchy:
    """A hierarchy of one attribute: `rules` for the levels above the leaves, or a `mapping` with columns l0 to lh.

    The leaves are the values that a table holds; `table()` lists them with their ancestors.
    """

    name: str
    rules: tuple = ()
    mapping: DataFrame | None = None

    @staticmethod
    def from_csv(spark: SparkSession, name: str, path: str, sep: str = ",") -> Hierarchy:
        return Hierarchy(name, mapping=read_mapping(spark, path, sep))

    @staticmethod
    def from_json(name: str, path: str) -> Hierarchy:
        """A rule file: 'lambda' levels if there are any, else 'tree' levels. FileNotFoundError if there is no file."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("lambda"):
            return Hierarchy(name, tuple(Expression(s) for s in spec["lambda"]))
        levels = []
        for level in spec["tree"]:
            if level.get("is_suppressed"):
                levels.append(Suppress())
                continue
            values = {str(o): v["generalized"] for v in level["values"] for o in v["original"]}
            if clash := [g for g in values.values() if g in values and values[g] != g]:
                raise ValueError(f"{name}: {clash[0]!r} is generalized and an original on the same level")
            levels.append(MapValues(values))
        return Hierarchy(name, tuple(levels))

    @property
    def height(self) -> int:
        return len(self.mapping.columns) - 1 if self.mapping is not None else len(self.rules)

    def level(self, value: Column, to: int, start: int = 0) -> Column:
        """The value of level `start` as a value of level `to`; rules only: a mapping table has to be joined, see levels()."""
        if self.mapping is not None:
            raise ValueError(f"{self.name}: a mapping table has no rules; join its levels()")
        if not 0 <= start <= to <= self.height:
            raise ValueError(f"{self.name}: levels {start} to {to} are not within 0 to {self.height}")
        return reduce(lambda v, r: r.column(v), self.rules[start:to], value)

    def table(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """Leaves of df with all their levels, as text: l0 to lh."""
        if self.mapping is not None:
            return self.mapping.select(*[F.col(f"l{i}").cast("string") for i in range(self.height + 1)])
        c = F.col(f"`{column or self.name}`")
        distinct = df.select(c.alias("v")).filter("v is not null").distinct()
        return distinct.select(*[self.level(F.col("v"), i).cast("string").alias(f"l{i}") for i in range(self.height + 1)])

    def display(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """The table ordered by its levels, the most general first."""
        return self.table(df, column).orderBy(*[f"l{i}" for i in range(self.height, -1, -1)])

    def leaves(self, df: DataFrame, column: str | None = None) -> DataFrame:
        return self.table(df, column).select("l0")

    def nodes(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """One row per node: node, level (lowest), levels (how many it stands on), leaf_count (0 for a leaf)."""
        t = self.table(df, column)
        long = t.select("l0", F.posexplode(F.array(*t.columns)).alias("level", "node"))
        found = long.groupBy("node").agg(F.min("level").alias("level"), F.countDistinct("level").alias("levels"), F.countDistinct("l0").alias("leaf_count"))
        return found.select("node", "level", "levels", F.when(F.col("level") == 0, 0).otherwise(F.col("leaf_count")).cast("long").alias("leaf_count"))

    def contains(self, df: DataFrame, node: str, column: str | None = None) -> bool:
        if node == ANY:
            return True
        t = self.table(df, column)
        return bool(t.filter(F.array_contains(F.array(*t.columns), node)).limit(1).count())

    def leaves_under(self, df: DataFrame, node: str, column: str | None = None) -> DataFrame:
        """Leaves under an inner node: none under a leaf, all under '*'; UnknownNode otherwise."""
        t = self.table(df, column)
        if node == ANY:
            return t.select("l0")
        if not self.contains(df, node, column):
            raise UnknownNode(f"{self.name}: {node!r}")
        is_leaf = bool(t.filter(F.col("l0") == node).limit(1).count())
        return t.filter(F.lit(not is_leaf) & F.array_contains(F.array(*t.columns), node)).select("l0")

    def node_height(self, df: DataFrame, node: str, column: str | None = None) -> int:
        """0 for a leaf, the height for '*', else the one level that the node stands on."""
        if node == ANY:
            return self.height
        found = self.nodes(df, column).filter(F.col("node") == node).first()
        if found is None:
            raise UnknownNode(f"{self.name}: {node!r}")
        if found["level"] > 0 and found["levels"] > 1:
            raise ValueError(f"{self.name}: {node!r} stands on several levels")
        return found["level"]

    def levels(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """df with the column's value on every level, as text: {to}0 to {to}h. A value that a mapping lacks raises an error."""
        value = F.col("`" + column.replace("`", "``") + "`").cast("string")
        names = [f"{to}{i}" for i in range(self.height + 1)]
        if self.mapping is None:
            return df.select("*", *[self.level(F.col("`" + column.replace("`", "``") + "`"), i).cast("string").alias(n) for i, n in enumerate(names)])
        known = self.mapping.select(*[F.col(f"l{i}").cast("string").alias(n) for i, n in enumerate(names)]).dropDuplicates([names[0]])
        unknown = F.raise_error(F.concat(F.lit(f"{column}: not in its hierarchy: "), value)).cast("string")
        joined = df.join(known, value == F.col(names[0]), "left")
        return joined.withColumn(names[0], F.when(value.isNotNull(), F.coalesce(names[0], unknown)))

    def _agree(self, levels: list[Column]) -> list[Column]:
        """Aggregates over a group's leaves: for each level below the top, whether all agree."""
        return [F.min(x).eqNullSafe(F.max(x)) for x in levels[:-1]]

    def _texts(self, value: Column) -> list[Column]:
        return [self.level(value, i).cast("string") for i in range(self.height + 1)]

    def lca(self, value: Column | None = None, levels: list[Column] | None = None) -> Column:
        """Aggregate over a group's leaves: the value of their lowest common ancestor, '*' above the last level.

        Give the leaves themselves for a hierarchy of rules, or the columns that levels() made for any.
        """
        levels = levels or self._texts(value)
        out = F.lit(ANY)
        for x, same in reversed([*zip(levels, self._agree(levels), strict=False)]):
            out = F.when(same, F.min(x)).otherwise(out)
        return out

    def lca_height(self, value: Column | None = None, levels: list[Column] | None = None) -> Column:
        """Aggregate over a group's leaves: the level of their lowest common ancestor; see lca()."""
        levels = levels or self._texts(value)
        out = F.lit(self.height)
        for i, same in reversed([*enumerate(self._agree(levels))]):
            out = F.when(same, F.lit(i)).otherwise(out)
        return out

    def lca_nodes(self, groups: DataFrame, df: DataFrame, group: str = "group_id", node: str = "node", column: str | None = None) -> DataFrame:
        """group, lca, height: the lowest node that holds all nodes of each group, leaves and inner ones alike.

        '*' holds everything. A null node is left out; a node that is unknown raises an error when the result is computed.
        """
        t = self.table(df, column)
        chain = lambda i: F.array(*[F.struct(F.lit(j).alias("level"), F.col(f"l{j}").alias("above")) for j in range(i, self.height + 1)])
        each = t.select(F.explode(F.array(*[F.struct(F.col(f"l{i}").alias("n"), F.lit(i).alias("at"), chain(i).alias("up")) for i in range(self.height + 1)])).alias("x")).select("x.*")
        lowest = each.groupBy("n").agg(F.min_by("up", "at").alias("up"))  # a node's own level and those above it
        asked = groups.select(F.col(group).alias("g"), F.col(node).cast("string").alias("n")).filter("n is not null").distinct()
        top = F.when(F.col("n") == ANY, F.array(F.struct(F.lit(self.height).alias("level"), F.lit(ANY).alias("above"))))
        unknown = F.raise_error(F.concat(F.lit(f"{self.name}: no node of its hierarchy: "), F.col("n"))).cast("array<struct<level:int,above:string>>")
        met = asked.join(lowest, "n", "left").select("g", "n", F.coalesce(top, F.col("up"), unknown).alias("up"))
        sizes = met.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"))
        shared = met.select("g", F.explode("up").alias("u")).groupBy("g", "u.above").agg(F.min("u.level").alias("level"), F.count(F.lit(1)).alias("met"))
        found = shared.join(sizes, "g").filter(F.col("met") >= F.col("nodes")).groupBy("g").agg(F.min_by("above", "level").alias("lca"), F.min("level").alias("height"))
        both = sizes.join(found, "g", "left")
        return both.select(F.col("g").alias(group), F.coalesce("lca", F.lit(ANY)).alias("lca"), F.coalesce("height", F.lit(self.height)).cast("int").alias("height"))


def all_nodes(df: DataFrame, hierarchies: dict[str, Hierarchy]) -> DataFrame:
    """attribute, leaf, level, node of all hierarchies, in one long table."""
    parts = []
    for name, h in hierarchies.items():
        t = h.table(df, name)
        parts.append(t.select(F.lit(name).alias("attribute"), F.col("l0").alias("leaf"), F.posexplode(F.array(*t.columns)).alias("level", "node")))
    return reduce(DataFrame.unionByName, parts)
