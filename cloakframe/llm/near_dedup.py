"""SimHash near-duplicate detection over pigeonhole blocks.

A 64-bit fingerprint is split into four blocks of 16 bits. Two fingerprints that differ in at most two bits agree on at
least two whole blocks, so every such pair shares one of the six block pairs. Distinct fingerprints are joined on those
32-bit keys and verified by their Hamming distance. A bucket of more than BUCKET fingerprints is not expanded into
pairs: its members are joined on the 65 values within one bit of them instead, which two fingerprints share exactly
when they differ in at most two bits. Copies of one fingerprint are collapsed before and never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, bitmap, bound_batches, components, discard, fresh, load, materialize

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Buckets of up to so many distinct fingerprints are compared pair by pair.
BUCKET = 64
#: Shingles counted at a time, so that very long texts need no more memory.
CHUNK = 65_536


def fingerprint(text: str | None) -> int:
    """SimHash of a text: unsigned 64-bit; 0 without words. Null counts as empty."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at blank and \\t to \\r only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.fromiter((digest(next(grams), SEED) for _ in range(min(CHUNK, n - at))), ">u8", min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """docs with a long column `to`: the bits of each text's fingerprint."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())])
    at, names = docs.columns.index(text), [*docs.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fp = np.array([fingerprint(t) for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=names)

    return docs.mapInArrow(run, schema)


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges a, b between distinct fingerprints that connect exactly those within DISTANCE bits, directly or by others."""
    blocks = [F.shiftrightunsigned(F.col(fp), 48 - 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(combinations(range(4), 2))]
    keyed = nodes.select(F.col(fp).alias("fp"), F.explode(F.array(*keys)).alias("key"))
    counts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "block-sizes")
    shared = materialize(attach(keyed, counts, "key", "n", 6 * nodes.count()).filter("n is not null"), "blocks")
    discard(counts)
    few = shared.filter(F.col("n") <= BUCKET)
    a, b = few.alias("a"), few.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    hubs = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]]
    many = shared.filter(F.col("n") > BUCKET).select("fp").distinct().select("fp", F.explode(F.array(*hubs)).alias("hub"))
    stars = many.groupBy("hub").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)  # at most 65 in each
    spokes = stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return pairs.union(spokes).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at DISTANCE or fewer differing bits; component_id is the smallest doc_id reachable over links, the
    document's own included. Null and wordless texts have fingerprint zero and link like any other. Null ids come last
    when the smallest is sought; repeated rows repeat in the result; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))).select("doc_id", "fp"), "fingerprints")
    return _components(fps)


def _components(fps: DataFrame) -> DataFrame:
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes))
    joined = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    linked = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    per_fp = materialize(attach(joined, linked, "root", "members", nodes.count()).select("fp", "n", "component_id"), "component-of")
    out = attach(fps, per_fp, "fp", "n", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id, with all its columns.

    Texts are not shuffled but for rows that a bitmap of bounded size flags as possibly dropped. Null and wordless texts
    are one group, as near_groups() says, and null ids come last; of rows repeating the smallest id exactly one stays.
    Texts may be of any length that a row holds; other columns stay whatever their names; an empty table gives no rows.
    """
    uid, fp, may = fresh(docs, "uid", "fp", "may")
    source = docs.withColumn(uid, F.monotonically_increasing_id())
    tagged = materialize(fingerprints(source.withColumn(text, F.col(text).cast("string")), text, fp), "tagged")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(uid).alias("uid"))
    narrow = tagged.select(F.col(fp).alias("fp"), order.alias("order"))
    nodes = materialize(narrow.groupBy("fp").agg(F.min("order").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    rooted = materialize(nodes.join(components(links(nodes)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("stays"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("fps")).filter("members > 1")
    of_fp = materialize(attach(rooted.select("fp", "n", "root"), groups, "root", "fps", rooted.count()).filter("stays is not null").select("fp", "n", "stays"), "stays")
    met = attach(narrow, of_fp, "fp", "n", tagged.count())
    dropped = materialize(met.filter("stays is not null and order.uid <> stays.uid").select(F.col("order.uid").alias(uid)), "dropped")
    flagged = bitmap(dropped, F.xxhash64(uid), max(20, dropped.count().bit_length() + 4)).flag(tagged, F.xxhash64(uid), may)
    return flagged.filter(~F.col(may)).select(*docs.columns).unionByName(flagged.filter(F.col(may)).join(dropped, uid, "left_anti").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))
