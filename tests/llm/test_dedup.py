import re

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import common, exact_dedup, near_dedup

from . import brute

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (7, " "), (4, "A b"), (8, "x" * 50_000), (6, "x" * 50_000), (6, "x" * 50_000), (10, "a b"), (None, "a b"), (None, None)]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(brute.frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted((str(i), str(min(x for x in g if x is not None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_keeps_rows_and_columns(spark):
    docs = brute.frame(spark, ROWS)
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 6, 7, 10]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [15, 27])
def test_hot_group_and_full_bitmap(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "MAX_BITS", bits)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.filter("group_size = 1000").count() == 1000 and got.filter("kept").count() == 2001
    assert exact_dedup.exact_dedup(docs).count() == 2001


def test_fingerprint_matches_its_definition():
    for t in ["", None, "one", "One two", "a b c d E", "Ä b c \x1c d e f", " lead  and\ttrail \n", "w " * 200_000, "é ß Z z"]:
        assert near_dedup.fingerprint(t) == brute.fingerprint(t) if t is None or len(t) < 1000 else near_dedup.fingerprint(t) >= 0


def test_near_groups_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 2)  # so that large buckets are used too
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()[:120]
    rows = [(r["doc_id"], r["text"]) for r in base]
    rows += [(1000 + i, r["text"].replace(" the ", " a ", 1)) for i, r in enumerate(base[:40])] + [(2000, None), (2001, ""), (2002, " ")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_dedup.near_groups(brute.frame(spark, rows)).collect()}
    fps = {i: brute.fingerprint(t) for i, t in rows}
    want = brute.component_ids(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i, _ in rows}
    kept = near_dedup.near_dedup(brute.frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and "_cf_h" in kept.columns


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_lose_none(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    base = [0x0123456789ABCDEF, -1, 0, 1 << 62]
    fps = {((b ^ (1 << i) ^ (1 << j)) + (1 << 63)) % (1 << 64) - (1 << 63) for b in base for i in range(0, 64, 7) for j in range(0, 64, 5)} | set(base)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(near_dedup.links(nodes)).collect()}
    unsigned = {f: f % (1 << 64) for f in fps}
    want = brute.component_ids(unsigned)
    for a in fps:
        for b in list(fps)[:20]:
            assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


def test_near_dedup_of_nothing_and_of_copies(spark):
    docs = brute.frame(spark, [(i, "same text here again") for i in range(50)])
    assert [r["doc_id"] for r in near_dedup.near_dedup(docs).collect()] == [0]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    twice = brute.frame(spark, [(1, "q"), (1, "q")])
    assert near_dedup.near_groups(twice).count() == 2 and near_dedup.near_dedup(twice).count() == 1


@pytest.mark.parametrize("order", ["far", "up", "mixed"])
def test_components_of_a_long_chain(spark, order, monkeypatch):
    n, rounds = 2048, []
    ids = {"far": [0, *range(n - 1, 0, -1)], "up": list(range(n)), "mixed": sorted(range(n), key=lambda i: i * 2654435761 % n)}[order]
    write = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: rounds.append(label) or write(df, label))
    monkeypatch.setattr(common, "HOT_LEAST", 50)  # so that hot roots are split
    got = common.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert got.filter("root = 0").count() == n and sum(r.endswith("-step") for r in rounds) <= 15


def test_stages_on_empty_tables(spark):
    docs = brute.frame(spark, [(1, "a")]).limit(0)
    assert near_dedup.near_dedup(docs).collect() == [] and near_dedup.near_dedup(docs).columns == docs.columns
