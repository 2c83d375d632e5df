"""Greedy clusterers, k-Member and OKA: exact sequential kernels on one block of rows, or on many blocks in parallel.

Each step of these algorithms depends on the one before, so the exact form is one Arrow task over all rows. The blocked
form cuts the table by Mondrian into blocks first and runs the kernel in each; its groups still have k rows, but are not
those of the global algorithm.

Kernels work on arrays: numbers, and for categories the number of the ancestor on each level, so that the level of a
lowest common ancestor is a comparison of columns. A step does not look at every row or cluster: these lie in cells with
bounds, and only cells that may hold the best are opened (Cells). What is found is what a full scan finds.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dense_index, materialize
from ..spec import AnonSpec, q
from .generalize import Result
from .mondrian import Mondrian
from .recode import GROUP, RECODERS

MIXED = -2  # in place of an ancestor's code: members of a cell differ


@dataclass
class Block:
    """Rows as arrays; per quasi-identifier either numbers with their range or ancestor codes (rows x levels + 1)."""

    numbers: list[np.ndarray | None]
    codes: list[np.ndarray | None]
    spans: list[float]

    def __len__(self) -> int:
        return len(next(x for x in (*self.numbers, *self.codes) if x is not None))

    def distance(self, i: int, rows: np.ndarray) -> np.ndarray:
        """From row i to rows."""
        out = np.zeros(len(rows))
        for num, code, span in zip(self.numbers, self.codes, self.spans, strict=True):
            if num is not None:
                out = out + (np.abs(num[i] - num[rows]) / span if span else 0.0)
            else:
                out = out + _lca(code[i][None, :] == code[rows]) / (code.shape[1] - 1)
        return out

    def distance_to(self, i: int, cells: Cells) -> np.ndarray:
        """At least the distance from row i to any row of each cell."""
        out = np.zeros(len(cells.rows))
        for num, code, lo, hi, shared, span in zip(self.numbers, self.codes, cells.lo, cells.hi, cells.codes, self.spans, strict=True):
            if num is not None:
                out = out + (np.maximum(np.abs(num[i] - lo), np.abs(num[i] - hi)) / span if span else 0.0)
            else:
                out = out + _lca(code[i][None, :] == shared) / (code.shape[1] - 1)
        return out

    def start(self, i: int) -> Cluster:
        return Cluster([i], [None if x is None else (x[i], x[i]) for x in self.numbers], [None if c is None else c[i].copy() for c in self.codes])


def _lca(same: np.ndarray) -> np.ndarray:
    """The first level on which all agree, else the height; same: rows x levels + 1, and is overwritten."""
    same[:, -1] = True
    return same.argmax(1)


@dataclass
class Cluster:
    rows: list[int]
    bounds: list[tuple[float, float] | None]
    shared: list[np.ndarray | None]  # the common ancestor's code on each level, -1 where members differ

    def losses(self, b: Block, rows: np.ndarray) -> np.ndarray:
        """Information loss of the cluster with each of the rows added."""
        out = np.zeros(len(rows))
        for num, code, span, bound, own in zip(b.numbers, b.codes, b.spans, self.bounds, self.shared, strict=True):
            if num is not None:
                wide = np.maximum(bound[1], num[rows]) - np.minimum(bound[0], num[rows])
                out = out + (wide / span if span else 0.0)
            else:
                out = out + _lca(own[None, :] == code[rows]) / (code.shape[1] - 1)
        return (len(self.rows) + 1) * out

    def add(self, b: Block, i: int) -> None:
        self.rows.append(i)
        self.bounds = [None if x is None else (min(x[0], n[i]), max(x[1], n[i])) for x, n in zip(self.bounds, b.numbers, strict=True)]
        self.shared = [None if s is None else np.where(s == c[i], s, -1) for s, c in zip(self.shared, b.codes, strict=True)]

    def loss(self, b: Block) -> float:
        total = 0.0
        for bound, own, span in zip(self.bounds, self.shared, b.spans, strict=True):
            if bound is not None:
                total += (bound[1] - bound[0]) / span if span else 0.0
            else:
                total += float(_lca((own >= 0)[None, :])[0]) / (len(own) - 1)
        return len(self.rows) * total

    def losses_from(self, b: Block, cells: Cells) -> np.ndarray:
        """At most the loss with any row of each cell added: losses() over bounds, with the same roundings."""
        out = np.zeros(len(cells.rows))
        for j, (lo, hi, span, bound, own) in enumerate(zip(cells.lo, cells.hi, b.spans, self.bounds, self.shared, strict=True)):
            if lo is not None:
                wide = np.maximum(bound[1], lo) - np.minimum(bound[0], hi)
                out = out + (wide / span if span else 0.0)
            else:
                out = out + cells.nearest_level(j, own) / (len(own) - 1)
        return (len(self.rows) + 1) * out


class Cells:
    """Points (rows or centers of clusters) in cells of points that lie close together, with the bounds of each cell.

    The points' arrays belong to the caller, who reports each change by drop() or move(). After as many changes as there are
    points, they are dealt to cells anew.
    """

    def __init__(self, numbers: list[np.ndarray | None], codes: list[np.ndarray | None], spans: list[float], points: np.ndarray, weights: np.ndarray | None = None):
        """points: which entries of the arrays, in ascending order."""
        self.numbers, self.points, self.spans, self.weights = numbers, codes, spans, weights
        self.bounded = all(math.isfinite(x) for x in spans)
        self._deal(points)

    def _deal(self, points: np.ndarray) -> None:
        odd = np.zeros(len(points), bool)  # distances to these are no numbers, which a scan takes for the best
        for num, span in zip(self.numbers, self.spans, strict=True):
            if num is not None and span:
                odd |= ~np.isfinite(num[points])
        size = max(64, math.isqrt(len(points)))
        strange, plain = points[odd], points[~odd]
        self.rows = [strange[i : i + size] for i in range(0, len(strange), size)]
        self.odd = len(self.rows)
        self.rows += self._cut(plain, size)
        self.home = np.full(int(points.max(initial=-1)) + 1, -1)
        n = len(self.rows)
        self.first = np.zeros(n, np.int64)
        self.lo = [None if x is None else np.zeros(n) for x in self.numbers]
        self.hi = [None if x is None else np.zeros(n) for x in self.numbers]
        self.codes = [None if c is None else np.zeros((n, c.shape[1]), np.int64) for c in self.points]
        self.bits = [None if c is None else np.zeros(x.shape, np.int64) for c, x in zip(self.points, self.codes, strict=True)]
        self.weight = np.ones(n)
        self.dead = np.zeros(n, bool)
        for c, rows in enumerate(self.rows):
            self.home[rows] = c
            self._measure(c)
        self.left, self.changes = len(points), 0

    def _cut(self, points: np.ndarray, size: int) -> list[np.ndarray]:
        """Parts of at most `size` points, each cut in two along the attribute in which it is widest."""
        out, todo = [], [points] if len(points) else []
        while todo:
            part = todo.pop()
            if len(part) <= size:
                out.append(np.sort(part))
                continue
            widest, by = 0.0, None
            for num, code, span in zip(self.numbers, self.points, self.spans, strict=True):
                if num is not None:
                    x = num[part]
                    wide = (x.max() - x.min()) / span if span else 0.0
                else:
                    mine = code[part]
                    level = int(_lca((mine == mine[0]).all(0)[None, :])[0])
                    wide, x = level / (code.shape[1] - 1), mine[:, max(level - 1, 0)]
                if wide > widest:
                    widest, by = wide, x
            at = len(part) // 2
            if by is not None:
                order = np.argsort(by, kind="stable")
                part = part[order]
                if by.dtype.kind != "f":  # between two ancestors
                    ends = np.flatnonzero(np.diff(by[order])) + 1
                    at = int(ends[np.abs(ends - at).argmin()])
            todo += [part[:at], part[at:]]
        return out

    def nearest_level(self, j: int, own: np.ndarray) -> np.ndarray:
        """At most the level on which any point of each cell agrees with `own`; a cell has a bit for its codes modulo 64."""
        return _lca((self.bits[j] >> (own & 63) & 1).astype(bool) & (own >= 0))

    def _measure(self, c: int) -> None:
        rows = self.rows[c]
        self.dead[c] = not len(rows)
        if not len(rows):
            return
        self.first[c] = rows[0]
        if self.weights is not None:
            self.weight[c] = self.weights[rows].min()
        for j, (num, code) in enumerate(zip(self.numbers, self.points, strict=True)):
            if num is not None:
                x = num[rows]
                self.lo[j][c], self.hi[j][c] = x.min(), x.max()
            else:
                mine = code[rows]
                self.codes[j][c] = np.where((mine == mine[0]).all(0), mine[0], MIXED)
                self.bits[j][c] = np.bitwise_or.reduce(np.where(mine < 0, 0, 1 << (mine & 63)), 0)

    def _changed(self) -> bool:
        """Whether the points were dealt anew."""
        self.changes += 1
        if anew := self.changes > self.left:
            self._deal(np.sort(np.concatenate(self.rows)))
        return anew

    def drop(self, i: int) -> None:
        c = self.home[i]
        rows = self.rows[c]
        self.rows[c] = rows = rows[rows != i]
        self.left -= 1
        if self._changed():
            return
        inner = len(rows) and self.weights is None and all(code is None or code[c].min() >= 0 for code in self.codes)
        if inner and all(num is None or lo[c] < num[i] < hi[c] for num, lo, hi in zip(self.numbers, self.lo, self.hi, strict=True)):
            self.first[c] = rows[0]
        else:
            self._measure(c)

    def move(self, i: int) -> None:
        """Point i has changed."""
        if not self._changed():
            self._measure(self.home[i])

    def least(self, low: np.ndarray, exact: Callable[[np.ndarray], np.ndarray]) -> int:
        """The point with the least exact value, the first of several; low: at most the value of any point of each cell.

        No number counts as the least, as in argmin.
        """
        if self.odd or not self.bounded or np.isnan(low.min()):
            low[np.isnan(low)] = -np.inf
            low[: self.odd if self.bounded else None] = -np.inf
        low[self.dead] = np.inf
        least = low.min()
        at = np.flatnonzero(low == least)
        best, found, take = np.inf, len(self.home), 1
        while True:
            if len(at) > take:
                at = at[[self.first[at].argmin()]] if take == 1 else at[np.argpartition(low[at], take - 1)[:take]]
            rows = self.rows[at[0]] if len(at) == 1 else np.sort(np.concatenate([self.rows[c] for c in at]))
            low[at] = np.inf
            values = exact(rows)
            i = int(values.argmin())
            value, row = float(values[i]), int(rows[i])
            value = -np.inf if math.isnan(value) else value
            if value < best or (value == best and row < found):
                best, found = value, row
            if low.min() > best:
                return found
            at = np.flatnonzero((low < best) | ((low == best) & (self.first < found) & ~self.dead))
            if not len(at):
                return found
            take *= 4


def k_member(b: Block, k: int, seed: int | None) -> tuple[list[list[int]], float]:
    """Clusters (rows in the order they joined) and the total information loss.

    A random row starts, then always the row furthest from the last start; each cluster takes the rows that cost least
    until it has k. The rest joins the cluster whose total loss is then least. Ties go to the first row or cluster.
    """
    cells = Cells(b.numbers, b.codes, b.spans, np.arange(len(b)))
    clusters: list[Cluster] = []
    last = None
    while cells.left >= k:
        if last is None:
            last = random.Random(seed).randrange(len(b))
        else:
            last = cells.least(-b.distance_to(last, cells), lambda rows, i=last: -b.distance(i, rows))
        cells.drop(last)
        cluster = b.start(last)
        while len(cluster.rows) < k:
            i = cells.least(cluster.losses_from(b, cells), lambda rows, c=cluster: c.losses(b, rows))
            cluster.add(b, i)
            cells.drop(i)
        clusters.append(cluster)
    losses = [c.loss(b) for c in clusters]
    for i in np.sort(np.concatenate(cells.rows)) if cells.left else ():
        totals = [float(c.losses(b, np.array([i]))[0]) for c in clusters]
        best = int(np.argmin(totals))
        clusters[best].add(b, int(i))
        losses[best] = totals[best]
    return [c.rows for c in clusters], float(sum(losses))


class _Centroids:
    """Centers of all clusters in arrays: sums of numbers, and the common ancestor's level and codes of categories."""

    def __init__(self, b: Block, seeds: list[int]):
        self.b, self.members = b, [[i] for i in seeds]
        self.size = np.ones(len(seeds), np.int64)
        self.mean = [None if x is None else x[seeds].astype(float) for x in b.numbers]
        self.sums = [([], []) if x is None else (x[seeds].astype(float).tolist(), [0.0] * len(seeds)) for x in b.numbers]
        self.shared = [None if c is None else c[seeds].copy() for c in b.codes]

    def distance(self, i: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at))
        for num, code, span, mean, own in zip(self.b.numbers, self.b.codes, self.b.spans, self.mean, self.shared, strict=True):
            if num is not None:
                out = out + (np.abs(num[i] - mean[at]) / span if span else 0.0)
            else:
                out = out + _lca(own[at] == code[i][None, :]) / (code.shape[1] - 1)
        return out

    def cells(self, at: np.ndarray) -> Cells:
        return Cells(self.mean, self.shared, self.b.spans, at, self.size)

    def best(self, i: int, cells: Cells) -> int:
        """The cluster of the cells nearest to row i, distance weighed by the cluster's size."""
        out = np.zeros(len(cells.rows))
        for j, (num, code, lo, hi, span) in enumerate(zip(self.b.numbers, self.b.codes, cells.lo, cells.hi, self.b.spans, strict=True)):
            if num is not None:
                out = out + (np.maximum(np.maximum(lo - num[i], num[i] - hi), 0.0) / span if span else 0.0)
            else:
                out = out + cells.nearest_level(j, code[i]) / (code.shape[1] - 1)
        return cells.least(cells.weight * out, lambda at: self.size[at] * self.distance(i, at))

    def refresh(self, c: int) -> None:
        rows = self.members[c]
        self.members[c], self.size[c] = [], 0
        for num, (total, lost) in zip(self.b.numbers, self.sums, strict=True):
            if num is not None:
                total[c] = lost[c] = 0.0
        for i in rows:
            self.add(c, i)

    def add(self, c: int, i: int) -> None:
        self.members[c].append(i)
        self.size[c] += 1
        for j, (num, code) in enumerate(zip(self.b.numbers, self.b.codes, strict=True)):
            if num is None:
                self.shared[j][c] = np.where(self.shared[j][c] == code[i], code[i], -1) if self.size[c] > 1 else code[i]
                continue
            total, lost = self.sums[j]
            x, before = float(num[i]), total[c]
            total[c] = after = before + x
            lost[c] += (before - after) + x if abs(before) >= abs(x) else (x - after) + before  # what rounding took, as in sum()
            whole = after + lost[c] if math.isfinite(lost[c]) else after
            self.mean[j][c] = whole / len(self.members[c])


def oka(b: Block, k: int, seed: int | None, removal: str = "closest") -> tuple[list[list[int]], float]:
    """Clusters and the total information loss.

    n // k random rows start the clusters. The other rows, last first, join the nearest cluster. Clusters of more than k
    give up what is over, by default the members closest to the center, and these, last first, fill clusters below k
    and then join the nearest of all.
    """
    n = len(b)
    rng = random.Random(seed)
    seeds = rng.sample(range(n), n // k)
    centers = _Centroids(b, seeds)
    every = np.arange(len(seeds))
    cells = centers.cells(every)
    for i in sorted(set(range(n)) - set(seeds), reverse=True):
        c = centers.best(i, cells)
        centers.add(c, i)
        cells.move(c)
    small = centers.cells(np.flatnonzero(centers.size < k))
    spare: list[int] = []
    for c in every:
        if centers.size[c] > k:
            rows = centers.members[c]
            far = [float(centers.distance(i, np.array([c]))[0]) for i in rows]
            order = sorted(range(len(rows)), key=lambda j: far[j])
            over = len(rows) - k
            gone = order[:over] if removal == "closest" else order[k:]
            spare += [rows[j] for j in gone]
            centers.members[c] = [rows[j] for j in (order[over:] if removal == "closest" else order[:k])]
            centers.refresh(c)
    cells = None
    while spare:
        i = spare.pop()
        if not small.left and cells is None:
            cells = centers.cells(every)
        near = small if small.left else cells
        c = centers.best(i, near)
        centers.add(c, i)
        if near is small and centers.size[c] >= k:
            small.drop(c)
        else:
            near.move(c)
    total = 0.0
    for rows in centers.members:
        cluster = b.start(rows[0])
        for i in rows[1:]:
            cluster.add(b, i)
        total += cluster.loss(b)
    return centers.members, total


KERNELS: dict[str, Callable] = {"k_member": k_member, "oka": oka}


@dataclass(frozen=True)
class Clusterer:
    """k-Member or OKA over a spec. block_rows=None: exact; else Mondrian blocks of that size."""

    spec: AnonSpec
    k: int
    method: str = "k_member"
    recoder: str = "summarization"
    seed: int | None = None
    block_rows: int | None = None
    removal: str = "closest"  # OKA: which members an over-full cluster gives up, "closest" or "furthest"

    def _encoded(self) -> tuple[DataFrame, list[float], list[int]]:
        """key, block, and a column for each quasi-identifier: a double, or an array of its ancestors from leaf to top."""
        spec = self.spec
        values, heights = [], []
        for i, c in enumerate(spec.qids):
            if spec.categorical[c]:
                h = spec.hierarchy(c)
                heights.append(h.height)
                if h.mapping is not None:
                    raise ValueError(f"{c}: clusterers need a hierarchy of rules")
                values.append(F.array(*[h.level(F.col(q(c)), lv).cast("string") for lv in range(h.height + 1)]).alias(f"q{i}"))
            else:
                heights.append(0)
                values.append(F.col(q(c)).cast("double").alias(f"q{i}"))
        nums = spec.qids_numerical
        row = spec.df.agg(*[(F.max(q(c)) - F.min(q(c))).cast("double").alias(f"s{i}") for i, c in enumerate(nums)]).first() if nums else None
        spans = {c: row[f"s{i}"] or 0.0 for i, c in enumerate(nums)}
        source, block = spec.df, F.lit(0).cast("long")
        if self.block_rows:
            source, block = Mondrian(spec, max(self.k, self.block_rows // 2)).groups(), F.col(GROUP)
        rows = source.select(F.col(q(spec.order_key)).cast("long").alias("key"), block.alias("block"), *values)
        return rows, [spans.get(c, 0.0) for c in spec.qids], heights

    def assign(self) -> DataFrame:
        """key, group_id, member_pos (the order in which members joined), information_loss of the row's block."""
        if self.k < 2:
            raise ValueError("k must be at least 2")
        n = self.spec.df.count()
        if n < self.k:
            raise ValueError(f"{n} rows cannot form a group of {self.k}")
        rows, spans, heights = self._encoded()
        more = {"removal": self.removal} if self.method == "oka" else {}
        kernel, k, seed, flags = KERNELS[self.method], self.k, self.seed, [self.spec.categorical[c] for c in self.spec.qids]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key", ignore_index=True)
            numbers, codes = [], []
            for i, cat in enumerate(flags):
                if not cat:
                    numbers.append(pdf[f"q{i}"].to_numpy(float))
                    codes.append(None)
                    continue
                levels = [pd.factorize(pdf[f"q{i}"].str[lv], use_na_sentinel=False)[0] for lv in range(heights[i] + 1)]
                numbers.append(None)
                codes.append(np.stack(levels, 1))
            clusters, loss = kernel(Block(numbers, codes, spans), k, seed, **more)
            out = [(pdf["key"].iat[r], pdf["block"].iat[0], g, p, loss) for g, rows in enumerate(clusters) for p, r in enumerate(rows)]
            return pd.DataFrame(out, columns=["key", "block", "cluster", "member_pos", "information_loss"])

        got = rows.groupBy("block").applyInPandas(run, "key long, block long, cluster long, member_pos long, information_loss double")
        got = materialize(got, "clusters")
        ids = dense_index(got.select("block", "cluster").distinct(), GROUP, "block", "cluster")
        return got.join(ids, ["block", "cluster"]).select("key", GROUP, "member_pos", "information_loss")

    def groups(self) -> DataFrame:
        df = self.spec.df
        keyed = self.assign()
        return df.join(keyed.select("key", GROUP, "member_pos"), df[q(self.spec.order_key)] == keyed["key"]).drop("key")

    def transform(self) -> Result:
        groups = materialize(self.groups(), "groups")
        more = {"order": "member_pos"} if self.recoder == "mean_mode" else {}
        return Result(RECODERS[self.recoder](groups, self.spec, **more).drop(GROUP, "member_pos"), groups=groups)
