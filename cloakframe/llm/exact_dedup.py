"""Exact deduplication by two-pass Bloom filtering.

Pass 1 builds a blocked Bloom filter with plain aggregates: every row sets one bit of one 64-bit block, and a block that
received more rows than it has bits set may hold a repeated hash. Partial aggregation combines blocks on the map side;
no row or text moves. Pass 2 folds the flagged blocks into a bitmap of bounded size, broadcasts it, and tests every row:
rows that pass straight through are certainly unique, only the others are shuffled and grouped exactly. A false positive
costs a shuffled row, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, attach, bitmap, fresh, load, materialize

#: White space that counts as equal: blank, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text (null: empty) with every run of white space replaced by one blank."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def repeat_filter(hashes: DataFrame, h: str, rows: int) -> Bitmap:
    """The bitmap of hashes that may be repeated; h: a 64-bit hash in every row of `hashes`, of which there are `rows`."""
    log_blocks = min(48, max(10, (max(rows, 1) - 1).bit_length()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(h).bitwiseAND(F.lit(63)).cast("int"))
    block = F.shiftrightunsigned(F.col(h), 64 - log_blocks)
    blocks = hashes.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("seen"), F.count(F.lit(1)).alias("n"))
    flagged = blocks.filter(F.col("n") > F.bit_count("seen")).select("block")
    return bitmap(flagged, F.col("block"), log_blocks, lambda c: F.shiftrightunsigned(c, 64 - log_blocks))


def _decide(rows: DataFrame, sha: str, doc_id: str, uid: str, total: int) -> tuple[DataFrame, str, str]:
    """rows with two more columns, whose names come too: id and uid of the row that stays, and its group's size."""
    keep, size = fresh(rows, "keep", "size")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(uid).alias("uid"))
    groups = materialize(rows.groupBy(sha).agg(F.min(order).alias(keep), F.count(F.lit(1)).alias(size)), "groups")
    return attach(rows, groups, sha, size, total), keep, size


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those identical after white-space runs become one blank; null counts as empty. The smallest doc_id
    of a group stays (null ids come last; of rows repeating that id exactly one is kept). An empty table gives no rows.
    Other columns of docs are ignored, whatever their names.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("uid"))
    keyed = materialize(keyed, "keyed")
    h = keyed.withColumn("h", F.xxhash64("text_sha256"))
    total = keyed.count()
    found = repeat_filter(h, "h", total).flag(h, F.col("h"), "again").drop("h")
    again, keep, size = _decide(found.filter("again"), "text_sha256", "doc_id", "uid", total)
    once = found.filter("not again")
    kept = F.col("uid") == F.col(f"{keep}.uid")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return again.select("doc_id", F.col(f"{keep}.id").alias("keep_id"), F.col(size).alias("group_size"), kept.alias("kept"), "text_sha256").unionByName(
        once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ).select(*cols)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups().

    Rows whose hash occurs once pass straight through; only rows that may be repeated are written, shuffled and grouped.
    """
    sha, h, again, uid = fresh(docs, "sha", "h", "again", "uid")
    hashed = docs.withColumn(sha, F.sha2(normalised(F.col(text)), 256)).withColumn(h, F.xxhash64(F.col(sha)))
    narrow = materialize(hashed.select(h), "hashes")
    total = narrow.count()
    found = repeat_filter(narrow, h, total).flag(hashed, F.col(h), again)
    rows = materialize(found.filter(F.col(again)).withColumn(uid, F.monotonically_increasing_id()), "repeated")
    decided, keep, _ = _decide(rows, sha, doc_id, uid, total)
    kept = decided.filter(F.col(uid) == F.col(f"{keep}.uid"))
    return found.filter(~F.col(again)).select(*docs.columns).unionByName(kept.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
