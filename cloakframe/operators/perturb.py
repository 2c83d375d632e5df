"""Probabilistic k-anonymity by randomization: retention replacement of categories and Laplace noise on numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uniform import uniform
from ..spec import AnonSpec, q

ERROR = 1e-6


def attained_k(p: float, sizes: list[int], n: int) -> float:
    """The k of probabilistic k-anonymity that retention p gives for domains of these sizes."""
    product = math.prod((1 - p) / (1 + (s - 1) * p) for s in sizes)
    return 1 + (n - 1) * product**2


def solve_p(k: int, n: int, sizes: list[int], error: float = ERROR) -> float:
    """Retention p by bisection, to `error` in k."""
    if not sizes:
        raise ValueError("retention needs a categorical attribute")
    if not 1 < k < n:
        raise ValueError(f"k must lie between 1 and the number of rows, {n}")
    low, high = 0.0, 1.0
    while True:
        p = (low + high) / 2
        got = attained_k(p, sizes, n)
        if abs(got - k) <= error or high - low < 1e-15:
            return p
        low, high = (p, high) if got > k else (low, p)


def solve_b(k: int, n: int, numeric: int) -> float:
    """Scale of the Laplace noise, in units of the attribute's range."""
    if not 1 < k < n:
        raise ValueError(f"k must lie between 1 and the number of rows, {n}")
    return 2 * numeric / math.log((n - 1) / (k - 1))


@dataclass(frozen=True)
class Perturbation:
    """Randomizes every quasi-identifier of the spec; one projection once the parameters are known.

    A category stays with probability p + (1 - p) / s and otherwise becomes any other of the s values alike. A number
    gets Laplace noise of scale b times the range, is clamped to the range, and gets its type back. Nulls stay.
    """

    spec: AnonSpec
    k: int
    seed: int = 0

    def parameters(self) -> dict:
        df, spec = self.spec.df, self.spec
        aggs = [F.count(F.lit(1)).alias("n"), *[F.min(q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(spec.qids_numerical)], *[F.max(q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(spec.qids_numerical)]]
        row = df.agg(*aggs, *[F.countDistinct(q(c)).alias(f"s{i}") for i, c in enumerate(spec.qids_categorical)]).first()
        sizes = [row[f"s{i}"] for i in range(len(spec.qids_categorical))]
        out = {"n": row["n"], "sizes": sizes, "bounds": {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(spec.qids_numerical)}}
        out["p"] = solve_p(self.k, row["n"], sizes) if sizes else None
        out["b"] = solve_b(self.k, row["n"], len(spec.qids_numerical)) if spec.qids_numerical else None
        return out

    def category(self, c: str, p: float, domain: Column, size: int) -> Column:
        """u < p keeps the value; otherwise any value of the domain, itself included, alike."""
        key, value = F.col(q(self.spec.order_key)), F.col(q(c))
        pick = F.floor(uniform(self.seed, f"value:{c}", key) * size).cast("int")
        return F.when(value.isNull() | (uniform(self.seed, f"keep:{c}", key) < p), value).otherwise(F.get(domain, pick))

    def number(self, c: str, b: float, lo: float, hi: float) -> Column:
        u = F.greatest(uniform(self.seed, f"noise:{c}", F.col(q(self.spec.order_key))), F.lit(2.0**-53)) - 0.5
        noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) * (b * (hi - lo))
        value = F.least(F.greatest(F.col(q(c)).cast("double") + noise, F.lit(lo)), F.lit(hi))
        return F.when(F.col(q(c)).isNotNull(), value).cast(dict(self.spec.df.dtypes)[c])

    def transform(self) -> DataFrame:
        par, df = self.parameters(), self.spec.df
        for i, c in enumerate(self.spec.qids_categorical):
            values = df.select(F.col(q(c)).alias("v")).filter("v is not null").distinct().agg(F.array_sort(F.collect_list("v")).alias(f"_dom{i}"))
            df = df.join(F.broadcast(values)) if par["sizes"][i] <= 100_000 else df.join(values)  # one row
            df = df.withColumn(c, self.category(c, par["p"], F.col(f"_dom{i}"), par["sizes"][i])).drop(f"_dom{i}")
        for c in self.spec.qids_numerical:
            df = df.withColumn(c, self.number(c, par["b"], *par["bounds"][c]))
        return df
