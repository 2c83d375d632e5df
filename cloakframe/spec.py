"""The dataset model: a DataFrame with its quasi-identifiers, their kinds, hierarchies, target and row key."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hierarchy import Hierarchy
from .sources.tables import hierarchy_files, read_csv, read_props

#: Specs by name, as they are registered.
REGISTRY: dict[str, AnonSpec] = {}


def q(name: str) -> str:
    """A column name in backticks, so that any character may stand in it."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class AnonSpec:
    """What an operator needs to know of a table. `order_key` must be unique: a table has no order of its own."""

    df: DataFrame
    qids: tuple[str, ...]
    categorical: dict[str, bool]
    target: str | None = None
    order_key: str | None = None
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)
    name: str = "table"

    def __post_init__(self) -> None:
        names = [x for x in (*self.qids, self.target, self.order_key) if x is not None]
        if missing := [x for x in names if x not in self.df.columns]:
            raise ValueError(f"no such columns: {missing}")
        if missing := [x for x in self.qids if x not in self.categorical]:
            raise ValueError(f"is it categorical or not: {missing}")

    @staticmethod
    def by_index(df: DataFrame, qi_index: list[int], is_category: list[bool], target: str | None = None, **more) -> AnonSpec:
        """Quasi-identifiers by their places among the columns."""
        names = tuple(df.columns[i] for i in qi_index)
        return AnonSpec(df, names, {n: c is True for n, c in zip(names, is_category, strict=True)}, target, **more)

    @staticmethod
    def from_folder(spark: SparkSession, folder: str, name: str, order_key: str | None = None) -> AnonSpec:
        """A folder with {name}.csv, props.json and hierarchies/*.json; a row_id in file order is the key by default."""
        path = os.path.join(folder, f"{name}.csv")
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        df, props = read_csv(spark, path), read_props(os.path.join(folder, "props.json"))
        if order_key is None:
            order_key = "row_id"
            rows = df.coalesce(1).withColumn(order_key, F.monotonically_increasing_id())  # one file, one partition: file order
            df = rows.select(*df.columns, order_key)
        found = {n: Hierarchy.from_json(n, p) for n, p in hierarchy_files(os.path.join(folder, "hierarchies")).items()}
        return AnonSpec.by_index(df, props["qi_index"], props["is_category"], props["target"], order_key=order_key, hierarchies=found, name=name)

    @property
    def qids_idx(self) -> list[int]:
        return [self.df.columns.index(c) for c in self.qids]

    @property
    def qids_categorical(self) -> list[str]:
        return [c for c in self.qids if self.categorical[c]]

    @property
    def qids_numerical(self) -> list[str]:
        return [c for c in self.qids if not self.categorical[c]]

    @property
    def qids_idx_categorical(self) -> list[int]:
        return [self.df.columns.index(c) for c in self.qids_categorical]

    @property
    def qids_idx_numerical(self) -> list[int]:
        return [self.df.columns.index(c) for c in self.qids_numerical]

    def with_df(self, df: DataFrame, name: str | None = None) -> AnonSpec:
        """The same metadata over other rows, such as a sample."""
        return replace(self, df=df, name=name or self.name)

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 0) -> AnonSpec:
        """The same metadata over an exact sample, stratified by the target."""
        from .operators.sampling import stratified_sample

        return self.with_df(stratified_sample(self.df, self.target, self.order_key, n, frac, seed), f"{self.name}_sample")

    def register(self) -> AnonSpec:
        REGISTRY[self.name] = self
        return self

    def hierarchy(self, name: str | int) -> Hierarchy:
        name = self.df.columns[name] if isinstance(name, int) else name
        if name not in self.hierarchies:
            raise AttributeError(f"{name} has no hierarchy")
        return self.hierarchies[name]

    def info(self) -> DataFrame:
        """attribute, qid, numerical, categorical ('o' or empty), distinct_count (a null is one value), in one pass."""
        cols = [c for c in self.df.columns if c != self.order_key]
        counts = self.df.agg(*[(F.countDistinct(q(c)) + F.coalesce(F.max(F.col(q(c)).isNull().cast("long")), F.lit(0))).alias(f"c{i}") for i, c in enumerate(cols)])
        flag = lambda on: F.lit("o" if on else "")
        rows = [F.struct(F.lit(c).alias("attribute"), flag(c in self.qids).alias("qid"), flag(c in self.qids and not self.categorical[c]).alias("numerical"), flag(c in self.qids and self.categorical[c]).alias("categorical"), F.col(f"c{i}").alias("distinct_count")) for i, c in enumerate(cols)]
        return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    def describe(self) -> DataFrame:
        """name, n_rows, n_columns."""
        return self.df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(str(self)).alias("name"), "n_rows", F.lit(len([c for c in self.df.columns if c != self.order_key])).cast("long").alias("n_columns"))

    def __str__(self) -> str:
        return self.name.upper()
