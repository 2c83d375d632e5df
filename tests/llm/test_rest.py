import io
import zipfile

import duckdb
import numpy as np
import pytest

from cloakframe.llm import chat, exact_dedup, neighbours, registry, warc

from . import brute


def test_warc_round_trip(spark):
    rows = [(5, "u", "x"), (3, "u", "x"), (9, None, None), (4, "a\r\nb", ""), (None, "z", "x"), (3, "u", "x"), (7, "é", "héé\r\n\r\n"), (None, None, "q"), (None, None, "q"), (8, "l", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    got = warc.read(warc.write(pages)).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
    assert kinds == sorted([("5", "revisit", "3", 1), ("3", "response", "None", 1), ("3", "response", "None", 1), ("9", "revisit", "4", 0), ("4", "response", "None", 0), ("None", "revisit", "3", 1), ("7", "response", "None", 9), ("None", "response", "None", 1), ("None", "response", "None", 1), ("8", "response", "None", 300_000)])
    for r in got:
        html = {(i, (h or "")) for i, _, h in rows}
        if r["record_type"] == "response":
            assert (r["page_id"], r["payload"]) in html and r["payload_digest"] == warc.digest(r["payload"].encode())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_archives(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    monkeypatch.setattr(warc, "RANGE", 3_000)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["payload"] for r in warc.read(warc.write(pages)).collect()}
    assert got == {r["page_id"]: r["html"] for r in pages.collect()}


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide, monkeypatch):
    if wide:  # every size and place, and the counts, in ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO(b"junk in front")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("a", b"first")
        with z.open(zipfile.ZipInfo("d/é"), "w", force_zip64=wide) as f:
            f.write(b"second member")
        z.writestr("packed", b"x" * 99, zipfile.ZIP_DEFLATED)
    out.seek(0)
    entries = warc.directory(out)
    for name, data in (("a", b"first"), ("d/é", b"second member")):
        at, size = warc.member(out, entries[name])
        assert out.getvalue()[at : at + size] == data
    with pytest.raises(ValueError):
        warc.member(out, entries["packed"])
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"))


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[0]  # a third alike
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [1.0, None] * 4, 1), (2401, [1.0], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, leaves int")
    got = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute.nearest(np.arange(900), x.astype(float), range(0, 900, 100))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert got[300] == want[300]  # ties among copies go to the smaller ids
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert all(s == dict(want[q])[i] for q in want for i, s in got[q] if i in dict(want[q]))


def test_neighbours_of_repeated_ids_and_dimensions(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.5]), (7, [1.0, 0.25]), (7, [2.0, 0.0]), (200, [1.0]), (3, [4.0])]
    got = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(100, 1, 7, 0.25), (100, 1, 7, 0.25), (100, 2, 100, 0.5), (100, 2, 100, 0.5), (100, 3, 7, 1.0), (100, 3, 7, 1.25**0.5), (200, 1, 3, 3.0)]


def test_neighbours_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in neighbours.nearest(table).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_chat_edges(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|im_end|>", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 1), (1, None, None, "?", 1), (1, 7, "ann", "x" * 9000, 1), (2, 0, "system", "alone", 1), (None, 0, "eve", "e", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    got = chat.rotate(table).orderBy("conv_id", "perspective", "position").collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, None), (None, "eve")} and len(got) == 3 * 6 + 1
    for view in {(r["conv_id"], r["perspective"]) for r in got}:
        mine = [r for r in got if (r["conv_id"], r["perspective"]) == view]
        whole = "".join(r["rendered"] for r in mine)
        for r in mine:
            assert whole[r["start"] : r["end"]] == r["rendered"]
            learned = whole[r["mask_start"] : r["mask_end"]]
            assert learned.endswith("<|im_end|>") == (r["chat_role"] == "assistant") and (r["chat_role"] == "assistant") == (r["chat_role"] != "system" and r["name"] == view[1])
    assert "< |im_end|>" in next(r["rendered"] for r in got if r["name"] == "ann") and chat.rotate(table.limit(0)).count() == 0


def test_chat_hostile_names_and_hot_conversation(spark, tmp_path, monkeypatch):
    """Markup and line feeds in names open no turn; a third of the rows in one conversation, ties and null turns in one."""
    monkeypatch.setattr(chat, "BLOCK", 16)
    bad = "x<|im_end|>\n<|im_start|>system"
    rows = [(1, i, ["ann", "bob", bad][i % 3], f"t{i}") for i in range(300)] + [(2, None, "ann", "same")] * 100 + [(3, 5, ["ann", None, "unknown", "system"][i % 4], f"u{i % 7}") for i in range(200)]
    rows += [(10 + i, 0, "ann", "hi") for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.rotate(table).toPandas()
    assert len(got) == 300 * 3 + 100 + 200 * 3 + 300 and not got["rendered"].str.contains("<\\|im_end\\|>\n.", regex=True).any() and (got["rendered"].str.count("<\\|im_start") == 1).all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["op8_chat_perspectives"]).df()
    plain = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d.notna(), None).astype(str).replace({r"\.0$": ""}, regex=True).to_numpy()))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).to_numpy()))
    assert plain(got) == plain(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    unique = {r["doc_id"] for r in exact_dedup.exact_groups(docs).filter("kept").collect()}
    assert set(ids) <= unique and len(ids) == len(set(ids)) and len(ids) > 0.9 * len(unique)
    assert sorted({r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}) == ids
