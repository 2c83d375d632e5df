"""Classic Mondrian: strict median partitioning, all groups of a level at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dense_index, materialize
from ..spec import AnonSpec, q
from .generalize import Result
from .recode import GROUP, RECODERS

#: Groups of up to so many distinct combinations are finished in one task each.
LOCAL = 20_000


@dataclass(frozen=True)
class Mondrian:
    """Splits at the median of the first quasi-identifier, widest range first, that leaves k rows on both sides.

    Ranges are relative to the whole column's; for categories they count distinct values, in order of appearance by the
    row key. Ties go to more distinct values, then to the first quasi-identifier. Null categories sort first.
    """

    spec: AnonSpec
    k: int
    recoder: str = "summarization"

    def _codes(self) -> tuple[DataFrame, list[float]]:
        """key, c0, c1, ...: numbers as they are, categories by first appearance; and each column's whole range."""
        spec = self.spec
        rows = spec.df.select(F.col(q(spec.order_key)).alias("key"), *[F.col(q(c)).alias(f"r{i}") for i, c in enumerate(spec.qids)])
        for i, c in enumerate(spec.qids):
            if spec.categorical[c]:
                codes = dense_index(rows.filter(f"r{i} is not null").groupBy(f"r{i}").agg(F.min("key").alias("first")), "code", "first")
                codes = codes.select(F.col(f"r{i}").alias("v"), F.col("code").cast("double").alias(f"c{i}"))
                rows = rows.join(codes, F.col(f"r{i}") == F.col("v"), "left").drop("v").withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(-1.0)))
            else:
                rows = rows.withColumn(f"c{i}", F.col(f"r{i}").cast("double"))
        cols = [f"c{i}" for i in range(len(spec.qids))]
        rows = materialize(rows.select("key", *cols), "codes")
        row = rows.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[(F.countDistinct(c).cast("double") if spec.categorical[n] else F.max(c) - F.min(c)).alias(c) for c, n in zip(cols, spec.qids, strict=True)]).first()
        rows = rows.select("key", *[F.coalesce(F.col(c), F.lit(row[f"lo_{c}"] or 0.0)).alias(c) for c in cols])
        return rows, [row[c] or 0.0 for c in cols]

    def groups(self) -> DataFrame:
        """The original rows with group_id: groups are numbered in depth-first order, low sides first.

        Rows of equal quasi-identifiers never part, so the rounds run over distinct combinations with their counts.
        """
        rows, spans = self._codes()
        n = range(len(spans))
        cols = [f"c{i}" for i in n]
        state = materialize(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).withColumn("path", F.lit("")), "combinations")
        ended = []
        while True:
            wide = materialize(state.groupBy("path").agg(F.count(F.lit(1)).alias("combos")).filter(F.col("combos") > LOCAL), "wide")
            more = wide.limit(1).count() > 0
            rest = state.join(wide, "path", "left_anti") if more else state
            ended.append(rest.groupBy("path").applyInPandas(self._finish(spans), ", ".join([*(f"{c} double" for c in cols), "path string"])))
            if not more:
                break
            state = state.join(wide.drop("combos"), "path")
            stats = []
            for i in n:
                distinct = F.countDistinct(f"c{i}")
                reach = distinct if self.spec.categorical[self.spec.qids[i]] else F.max(f"c{i}") - F.min(f"c{i}")
                stats += [distinct.alias(f"d{i}"), F.percentile(f"c{i}", F.lit(0.5), F.col("n")).alias(f"m{i}"), (reach / spans[i] if spans[i] else F.lit(0.0)).alias(f"w{i}")]
            per = materialize(state.groupBy("path").agg(F.sum("n").alias("rows"), *stats), "stats")
            sides = state.join(per, "path").groupBy("path").agg(*[F.sum(F.when(F.col(f"c{i}") <= F.col(f"m{i}"), F.col("n")).otherwise(0)).alias(f"low{i}") for i in n])
            fits = lambda i: (F.col("rows") >= 2 * self.k) & (F.col(f"low{i}") >= self.k) & (F.col("rows") - F.col(f"low{i}") >= self.k)
            order = F.array_sort(F.array(*[F.struct((-F.col(f"w{i}")).alias("w"), (-F.col(f"d{i}")).alias("d"), F.lit(i).alias("i"), F.col(f"m{i}").alias("m"), fits(i).alias("ok")) for i in n]))
            cut = F.get(F.filter(order, lambda s: s["ok"]), 0)
            chosen = materialize(per.join(sides, "path").select("path", cut.alias("cut")).filter("cut is not null"), "cuts")
            ended.append(state.join(chosen, "path", "left_anti"))
            value = reduce(lambda a, i: F.when(F.col("cut.i") == i, F.col(f"c{i}")).otherwise(a), n, F.lit(None).cast("double"))
            state = materialize(state.join(chosen, "path").withColumn("path", F.concat("path", F.when(value > F.col("cut.m"), "1").otherwise("0"))).drop("cut"), "frontier")
        combos = materialize(reduce(DataFrame.unionByName, [e.select(*cols, "path") for e in ended]), "paths")
        ids = dense_index(combos.select("path").distinct(), GROUP, "path")
        keyed = rows.join(combos, cols).join(ids, "path").select("key", GROUP)
        df = self.spec.df
        return df.join(keyed, df[q(self.spec.order_key)] == keyed["key"]).drop("key")

    def _finish(self, spans: list[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """Splits one group of at most LOCAL combinations to the end, by the same rule, in memory."""
        k, n, cats = self.k, len(spans), [self.spec.categorical[c] for c in self.spec.qids]

        def median(x: np.ndarray, w: np.ndarray) -> float:
            order = np.argsort(x, kind="stable")
            upto, total = np.cumsum(w[order]), int(w.sum())
            low, high = (x[order[np.searchsorted(upto, at, side="right")]] for at in ((total - 1) // 2, total // 2))
            return (low + high) / 2

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            c, w, base = pdf[[f"c{i}" for i in range(n)]].to_numpy(float), pdf["n"].to_numpy(), pdf["path"].iat[0]
            paths, todo = np.empty(len(c), object), [(np.arange(len(c)), base)]
            while todo:
                at, path = todo.pop()
                rows, ranked, cut = int(w[at].sum()), [], None
                if rows >= 2 * k:
                    for i in range(n):
                        x = c[at, i]
                        d = len(np.unique(x))
                        ranked.append((-((d if cats[i] else x.max() - x.min()) / spans[i]) if spans[i] else 0.0, -d, i))
                    for _, _, i in sorted(ranked):
                        m = median(c[at, i], w[at])
                        low = c[at, i] <= m
                        if k <= w[at[low]].sum() <= rows - k:
                            cut = low
                            break
                if cut is None:
                    paths[at] = path
                else:
                    todo += [(at[cut], path + "0"), (at[~cut], path + "1")]
            return pdf[[f"c{i}" for i in range(n)]].assign(path=paths)

        return run

    def transform(self) -> Result:
        groups = materialize(self.groups(), "groups")
        return Result(RECODERS[self.recoder](groups, self.spec).drop(GROUP), groups=groups)
