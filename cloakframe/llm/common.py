"""Shared building blocks: tables in the shared folder, fresh names, skew-safe joins, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import discard, materialize, shared_dir

__all__ = ["Bitmap", "attach", "bitmap", "bound_batches", "components", "discard", "fresh", "let", "load", "materialize", "scratch", "shared_dir"]

#: A key is hot when it holds at least this share of the rows; there are then at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: Fewer rows than this are never worth a separate way.
HOT_LEAST = 500
#: A broadcast bitmap has 2 ** MAX_BITS bits at most (16 MB); more values share bits then.
MAX_BITS = 27
#: Rows of an Arrow batch of texts, at most.
ARROW_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows in this session: a batch of texts is held several times over, on and off
    the executor's heap. A smaller setting of the user's stays. It is not set back: results are computed when their
    reader asks for them, and until then the setting must hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses, as a URI or an absolute path."""
    return f"{shared_dir(spark)}/cloakframe-{label}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that do not clash with those of df, upper and lower case alike."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        new = f"_cf_{n}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even when body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of `rows` with the one row that `groups` has for each non-null key.

    `groups[size]` counts the rows of a key and `total` all rows. Keys holding a thousandth of the rows or more, at most
    a thousand keys whatever the input, are broadcast, so that no task receives a hot key's rows; the rest is joined by
    a shuffle. No row is dropped.
    """
    least = max(HOT_LEAST, int(total * HOT_SHARE) + 1)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    return rows.join(hot, key, "inner").unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


@dataclass
class Bitmap:
    """A bitmap of bounded size, as rows of 4 kB: tells hashes that are certainly absent from those that may be there."""

    rows: DataFrame  # bucket, bits
    log_bits: int
    place: Callable[[Column], Column]

    def flag(self, df: DataFrame, h: Column, to: str) -> DataFrame:
        """df with a boolean column `to`: the hash may be in the bitmap. A map-side join with the broadcast bitmap."""
        bucket, bits = fresh(df, "bucket", "bits")
        pos = F.pmod(self.place(h), F.lit(1 << self.log_bits))
        one = F.conv(F.hex(F.substring(F.col(bits), (F.pmod(pos, F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.pmod(pos, F.lit(8)) + 1).cast("int"))
        side = F.broadcast(self.rows.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
        joined = df.join(side, F.shiftright(pos, 15) == F.col(bucket), "left")
        return joined.withColumn(to, F.coalesce(one.bitwiseAND(mask) > 0, F.lit(False))).drop(bucket, bits)


def bitmap(df: DataFrame, at: Column, log_bits: int, place: Callable[[Column], Column] = lambda h: h) -> Bitmap:
    """Sets the bit `at` of every row of df, folded into 2 ** log_bits bits (at most MAX_BITS); place(hash) is tested later."""
    log_bits = min(MAX_BITS, max(15, log_bits))
    pos = df.select(F.pmod(at, F.lit(1 << log_bits)).alias("pos"))
    rows = pos.groupBy(F.shiftright("pos", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("pos", F.lit(32768))).alias("bits"))
    return Bitmap(materialize(rows, "bitmap"), log_bits, place)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected `edges` (a, b: any comparable type): node, root = smallest node reachable.

    Each round every node sees the smallest root among its neighbours'; it and its own root hook onto that one, and then
    everyone takes the root of its root. Roots that see a smaller one thus at least halve in number, and the rounds grow
    with the logarithm of the nodes. Rounds are cut by tables in the shared folder; nodes with very many neighbours and
    roots of very many nodes are joined by broadcast (see attach). An empty edge table gives an empty result.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().withColumnRenamed("b", "node"), f"{label}-edges")
    first = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.least(F.first("node"), F.min("a")).alias("root"))
    state = materialize(first, label)
    links, nodes = both.count(), state.count()
    while True:
        seen = attach(both, state, "node", "degree", links).groupBy("a").agg(F.min("root").alias("near"))
        met = state.join(seen, state.node == seen.a).select("node", "degree", F.least("root", "near").alias("near"), "root")
        met = materialize(met, f"{label}-met")
        hooks = met.groupBy("root").agg(F.min("near").alias("to"), F.count(F.lit(1)).alias("size"))
        step = attach(met, hooks, "root", "size", nodes).select("node", "degree", F.least("near", "to").alias("next"), F.col("root").alias("was"))
        step = materialize(step, f"{label}-step")
        sizes = step.groupBy("next").agg(F.count(F.lit(1)).alias("size"))
        up = sizes.join(step.select(F.col("node").alias("next"), F.col("next").alias("above")), "next")
        new = materialize(attach(step, up, "next", "size", nodes).select("node", "degree", F.least("next", F.coalesce("above", "next")).alias("root"), "was"), label)
        changed = new.filter(F.col("root") != F.col("was")).limit(1).count()
        for t in (met, step, state):
            discard(t)
        state = new.drop("was")
        if not changed:
            discard(both)
            return state.select("node", "root")
