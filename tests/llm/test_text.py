import hashlib
import itertools
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from cloakframe.llm import bpe, language, packing, pii, toxicity

from . import brute

pii_words = regex.compile(pii.TERM)


def test_pii_spans_match_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("a1b2.@+- ()%_é4\n,😀9X") for _ in range(rnd.randint(0, 60)))) for i in range(1500)]
    rows += [(3000, None), (3001, ""), (3002, "1" * 50_000), (3003, "1 " * 20_000), (3004, "a" * 50_000), (3006, "1." * 20_000), (3007, "+1" + "(" * 50_000), (3008, "a@b.c " * 700), (3009, "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111"), (3010, "😀 a@b.c+d@e.f 1.2.3.256 001.2.3.255 +1 (743) 555-3824"), (3011, "1.2.3." + "0" * 60 + "7")]
    got = {r["doc_id"]: r for r in pii.pii_spans(brute.frame(spark, rows)).collect()}
    for i, t in rows:
        want = brute.spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[i]["spans"].startswith(text)
        assert [got[i][f"n_{k}"] for k, *_ in brute.KINDS] == [sum(x[0] == k for x in want) for k, *_ in brute.KINDS]


def test_disclosing_terms(spark):
    rows = [(i, f"word{i} filler text stuff. contact Zorblax Quimby at zorb@lax.com for item {chr(97 + i) * 4} today.") for i in range(8)]
    rows += [(100, "Zorblax is mentioned alone."), (101, None)] + [(200 + i, "contact filler text at today for item stuff other") for i in range(100)]
    docs = brute.frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(docs).collect()}
    assert "email" in got[0] and got[0].count("removed") + got[0].count("generalised") == 3 and "0:4" in got[0]  # "word" stands in no other document
    assert got[100].startswith(("removed:0:7", "generalised:0:7")) and not got[101] and not got[200]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zorblax" not in clean[0] + clean[100] and "[EMAIL]" in clean[0] and clean[101] is None and clean[200] == rows[-1][1]
    assert pii.sanitise(docs).columns == docs.columns and pii.pii_spans(docs.limit(0)).count() == 0


def test_copies_do_not_change_disclosing_terms(spark):
    rows = [(i, f"word{i} filler text stuff. contact Zorblax Quimby at zorb@lax.com for item {chr(97 + i) * 4} today.") for i in range(5)]
    rows += [(200 + i, f"contact filler text at today for item stuff other {chr(97 + i % 26) * (3 + i // 26)}") for i in range(100)]

    def found(more):
        docs = brute.frame(spark, rows + more)
        terms = pii.disclosing_terms(docs, pii.found_spans(docs, "doc_id", "text"), "text")
        return sorted(map(tuple, terms.collect()))

    alone = found([])
    assert [t for t, *_ in alone] == ["quimby", "word", "zorblax"] and found([(1000 + i, rows[0][1]) for i in range(60)]) == alone


def test_told_terms_match_brute_force(spark):
    """Terms, posteriors and classes over whole documents, with copies, several entities and terms that are no one's alone."""
    rnd = random.Random(6)
    names = ["xyloph", "zorblax", "quimby", "zorro", "zebra", "anders", "andere", "anton", "bert", "berta"]
    rows = []
    for i in range(240):
        words = rnd.choices(["the", "sea", "and", "hill", "zinc", "and", "bee", "ant"], k=6) + [rnd.choice(names) for _ in range(2)]
        mails = [f"{n}@x.org" for n in ("xyloph", "zorblax", "anders", "berta") if n in words] + ["all@x.org"] * (i % 40 == 0)
        rows.append((i, " ".join(words + mails + [f"q{i}"])))
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [(2000, None), (2001, "")]
    docs = brute.frame(spark, rows)
    found = pii.found_spans(docs, "doc_id", "text")
    got = sorted(map(tuple, pii.disclosing_terms(docs, found, "text").collect()))
    want = brute.told([t or "" for _, t in rows], pii.SUPPORT, pii.POSTERIOR, pii.DISCLOSURE)
    assert [(t, g) for t, _, g in got] == [(t, g) for t, _, g in want] and [p for _, p, _ in got] == pytest.approx([p for _, p, _ in want])
    assert any(g for _, _, g in got) and any(not g for _, _, g in got)  # both ways of sanitising
    texts_ = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    general = {t: g for t, _, g in got}
    for i, t in rows:
        assert texts_[i] == brute.sanitised(t, general)


def test_very_many_spans_in_a_text(spark):
    """100,000 addresses and thousands of told terms in each of three texts."""
    body = " ".join(f"u{i}@x.org" for i in range(100_000))
    rows = [(i, f"{body} {chr(97 + i) * 4} " + " ".join(f"zz{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(3000))) for i in range(3)]
    rows += [(100 + i, f"plain text number {i}") for i in range(40)]
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_email"], r["spans"].count("removed")) for r in pii.pii_spans(brute.frame(spark, rows)).collect()}
    masked = pii.sanitise(brute.frame(spark, rows[2:3])).first()["text"]
    assert got[0] == got[1] == got[2] == (100_000, 3000) and got[100] == (0, 0)
    assert masked.startswith("[EMAIL] [EMAIL] ") and masked.count("[EMAIL]") == 100_000 and "cccc zzaaa" in masked
    assert time.perf_counter() - began < 90


def test_masking_of_overlaps(spark):
    docs = brute.frame(spark, [(1, "call +1.2.3.4 5678 or a@1.2.3.4, é 4111 1111 1111 1111!")])
    assert pii.sanitise(docs).first()["text"] == "call [PHONE] or [EMAIL], é [CARD]!"


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def tokenizer(request):
    path = public_tokenizers.path(request.param)
    return bpe.Vocabulary.read(path), Tokenizer.from_file(path)


def texts():
    rnd = random.Random(3)
    wild = [*"abcABCß éÉÎİǅΣσς²½¾1२٣_'’\n\t\r\x1c\x85\xa0 .,!^<|>-=😀é日本", "<|endoftext|>", "<|startoftext|>", " the", " 's", "'ll", "^ ", "=", " ^", "^!"]
    plain = [*"abcABCßéÉ²½1_' \n.,!^<|>-=", "<|endoftext|>", " the", " ^\n", "^\n", "!"]
    made = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 30))) for al in (wild, plain) for _ in range(1500)]
    return [*made, "a" * 3000, "ab" * 5000, "", " ", "  ", "\n", "^\nfoo", " ^\nfoo", "!x", "=x", "<|endoftext|>", "x <|endoftext|> y"]


def on_disk(tmp_path, layout):
    (tmp_path / "lexicon").write_bytes(layout)
    return str(tmp_path / "lexicon")


def test_encoder_is_exact(tokenizer, tmp_path):
    vocabulary, library = tokenizer
    words = [b" the", b" th", b"the", b" a", b"abc"]
    encoder = bpe.Encoder(vocabulary, None if vocabulary.lower else on_disk(tmp_path, bpe.lexicon(words, vocabulary)))
    for t, got in zip(texts(), encoder.encode(texts()), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids
        if not vocabulary.lower:
            assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("slots", [6, 20])
def test_table_of_chunks_is_exact(tokenizer, monkeypatch, slots):
    """Full and crowded tables, windows that end within texts, chunks that share a key's bytes, length or start."""
    vocabulary, library = tokenizer
    if slots < 20:
        monkeypatch.setattr(bpe, "TABLE", slots)
        monkeypatch.setattr(bpe, "WINDOW", 1 << slots - 1)
    rnd = random.Random(4)
    made = [rnd.choice(["", "\n", " ", ",", "^", "=a", "!x", "a\0", "a", "é" * 11 + "x", "é" * 12, "İ", "it's", "x_", "'", "Ab," * 7 + "zz", "Ab," * 8]) + rnd.choice([" ", "\n", " ", "  "[: rnd.randint(1, 2)]]) for _ in range(4000)]
    rows = ["".join(made[i : i + rnd.randint(0, 60)]).strip("  "[: rnd.randint(0, 1)]) for i in range(0, 4000, 20)]
    rows += [" ".join(f"{chr(97 + i % 26)}{i}," for i in range(k, k + 90)) for k in range(0, 900, 30)]
    encoder = bpe.Encoder(vocabulary)
    for _ in range(2):
        for t, got in zip(rows, encoder.encode(rows), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunks_are_resolved_once(tokenizer, monkeypatch):
    """Chunks in greater number than a dictionary remembers at a time, met again in a later batch."""
    monkeypatch.setattr(bpe, "MEMO", 1000)
    encoder, resolved = bpe.Encoder(tokenizer[0]), []
    cut = encoder.cut
    encoder.cut = lambda chunks: resolved.extend(chunks) or cut(chunks)
    rows = [" ".join(f"w{i}," for i in range(k, k + 10)) for k in range(0, 5000, 5)]
    encoder.encode(rows)
    encoder.encode(rows)
    assert len(resolved) == len(set(resolved)) <= 5005 + 1000


def test_transducer_is_minimal_and_exact(tmp_path):
    words = [b"", b"tap", b"taps", b"top", b"tops", b"stop", b"stops", bytes(range(1, 40))]
    words = [w for w in words if w]
    made = bpe.Transducer(words, {w: np.array([i, i + 1], "<u4").tobytes() for i, w in enumerate(words)})
    lexicon = bpe.Lexicon(on_disk(tmp_path, made.layout()))
    probe = [*words, b"ta", b"tapss", b"x", b"s", b"a" * 100]
    numbers = lexicon.look(probe).tolist()
    assert [lexicon.bytes_of(n) for n in numbers[: len(words)]] == [np.array([i, i + 1], "<u4").tobytes() for i in range(len(words))] and set(numbers[len(words) :]) == {-1}
    assert sum(made.final) < len(words)  # endings are shared
    assert bpe.Lexicon(on_disk(tmp_path, bpe.Transducer([], {}).layout())).look([b"a"]).tolist() == [-1]


def test_encode_decode_query(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "Hello  world\n\n the end"), (3, "the the the"), (None, "né <|endoftext|> à")]
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in bpe.encode_decode(brute.frame(spark, rows), path).collect())
    want = sorted((str(i), ids, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert got == want and bpe.encode_decode(brute.frame(spark, rows).limit(0), path).count() == 0


def test_frequent_words_from_a_least_count_on(spark):
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    docs = brute.frame(spark, [(i, " ".join(["aa"] * 9 + ["bb"] * 9 + ["cc"] * 4 + ["dd", "dd", f"x{'abcdefghij'[i]}"])) for i in range(3)])
    got = [set(bpe.frequent_words(docs, vocabulary, most=n)) for n in (0, 1, 2, 3, 100)]
    ranked = [b" bb", b" aa", b" cc", b" dd", b"aa"]
    assert got == [set(ranked[:n]) for n in (0, 1, 2, 3, 100)]


def test_packing(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()[:60]] + [(900, None), (901, "a " * 9000), (901, "a " * 9000), (None, "b")]
    got = packing.packed(brute.frame(spark, rows), path, ids=True).collect()
    whole = {}
    for r in got:
        whole.setdefault(str(r["doc_id"]), []).append((r["piece"], r["start"], r["ids"]))
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(whole[str(i)])[:: 2 if i == 901 else 1]
        assert [x for _, _, p in parts for x in p] == ids and [s for _, s, _ in parts] == list(range(0, len(ids), 4096))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 2
    assert packing.packed(brute.frame(spark, rows).limit(0), path).count() == 0


def test_packing_of_one_size(spark):
    """A third or more of all rows alike: the sweep's partitions stay small and nothing is lost."""
    items = spark.range(3000).selectExpr("id AS uid", "IF(id % 3 = 0, 2048, 1000) AS size")
    got = packing.pack(items).groupBy("sequence_id").count().count()
    assert packing.pack(items).count() == 3000 and got <= 1.02 * (1000 * 2048 + 2000 * 1000) / 4096 + 1


@pytest.mark.parametrize("size", ["50", "IF(id % 100 = 0, 1000, 20 + id % 60)"])
def test_packing_of_short_documents(spark, size):
    """A gap takes one piece a round, far below the share of rounds that pay; the gaps must be filled all the same."""
    items = spark.range(30_000).selectExpr("id AS uid", f"{size} AS size")
    got = packing.pack(items).join(items, "uid").groupBy("sequence_id").agg({"size": "sum", "offset": "count", "*": "count"}).collect()
    tokens = items.selectExpr("sum(size)").first()[0]
    assert sum(r["count(1)"] for r in got) == 30_000 and all(r["sum(size)"] <= 4096 for r in got)
    assert len(got) <= 1.01 * tokens / 4096 + 2


def test_resolution_by_rank():
    docs, gaps = packing._resolve([(0, 0, 3), (1, 2, 1), (2, 5, 0)])
    assert sum(h - l for _, l, h, _ in docs) == sum(h - l for _, l, h, _ in gaps) == 4
    assert docs[0] == (1, 0, 2, 0) and gaps[0] == (0, 1, 3, 0)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    rows = brute.frame(spark, [(1, None), (2, ""), (3, "123 456 !!"), (4, "the " * 100_000), (4, "the end of the world"), (None, "x")])
    some = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.language_id(rows).collect()}
    assert {k: v for k, v in some.items() if k[0] in (1, 2, 3)} == {(1, "und"): 0.0, (2, "und"): 0.0, (3, "und"): 0.0} and all(0 <= v <= 1 for v in some.values())
    assert {r["doc_id"] for r in language.keep_identified(rows).collect()} == {4, None} and language.language_id(rows.limit(0)).count() == 0


def test_language_mixtures():
    model = language.Model(["en", "fr"], np.full((language.CELLS, 2), -11.0, np.float32))
    letters = language._letters()
    for name, words in (("en", "the and with from this"), ("fr", "les des une avec dans")):
        model.logp[language._grams([words], letters)[0], model.languages.index(name)] = -3
    pi, words = language.mixtures(["the and with", "the and les des", "avec dans", "", "the " * 30 + "les " * 10], model, letters)
    assert words.tolist() == [3, 4, 2, 0, 40] and pi[0].tolist() == [1, 0] and pi[2].tolist() == [0, 1] and pi[3].tolist() == [0, 0]
    assert pi[4] == pytest.approx([0.75, 0.25], abs=0.01)


def test_documents_in_several_languages_stay(spark):
    words = {"en": "the and with from this", "fr": "les des une avec dans", "de": "der und nicht auch sich"}
    rows = [(100 * k + i, t, n) for k, (n, t) in enumerate(words.items()) for i in range(40)]
    docs = spark.createDataFrame([*rows, (900, " ".join(words.values()), "en"), (901, "12 !", "en")], "doc_id long, text string, lang string")
    mixed = next(r for r in language.language_id(docs).collect() if r["doc_id"] == 900)
    assert len(mixed["languages"]) == 3 and mixed["score"] < 0.4
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert 900 in kept and 901 not in kept


def test_toxicity(spark):
    rnd = random.Random(5)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqr"]

    def text(toxic):
        base = [rnd.choice(words) for _ in range(30)]
        return " ".join([*base, "idiot"] if toxic else base)

    rows = [(i, text(i % 5 == 1)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i, _ in rows] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (1002, "idiot " * 50_000), (1003, "wak wbl")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(brute.frame(spark, rows + extra), labels).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 1) for i, _ in rows) and got[1002]["predicted"] == 1 and got[1003]["predicted"] == 0 and got[1000]["score"] == got[1001]["score"]
    assert toxicity.toxicity(brute.frame(spark, rows).limit(0), labels).count() == 0
    untaught = toxicity.toxicity(brute.frame(spark, extra), labels.limit(0)).collect()
    assert len(untaught) == 4 and all(0 <= r["score"] <= 1 for r in untaught)


def test_machine_learns_pairs():
    """Two terms that count only together: no sum of single weights separates them."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([c for c, on in ((10, a), (20, b)) if on], np.int64))
        y.append(float(a == b))
    m = toxicity.train(np.array([10, 20]), rows, np.array(y))
    z = m.score(np.array([0, 0, 1, 1]), np.array([0, 1, 3]), np.array([1, 2, 1]))
    assert z[0] < 0 < z[1] and z[2] < 0


def test_pair_among_thousands_of_words(spark):
    """The label is whether both or neither of two words stand in a text: neither tells anything alone."""
    rnd = random.Random(8)
    letters = "abcdefgh"
    words = ["".join(x) + "z" for x in itertools.product(letters, repeat=4)] + ["".join(x) + "yy" for x in itertools.product(letters, repeat=4)]
    rows, labels = [], []
    for i in range(8000):
        on = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((i, " ".join([*rnd.choices(words, k=30), *(w for w, o in zip(("alpha", "bravo"), on, strict=True) if o)])))
        labels.append((i, 1, int(on[0] == on[1])))
    assert len(words) > 8000
    got = toxicity.toxicity(brute.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, text int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 8000 and sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) >= 0.95 * len(held)


def test_score_is_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts_ = ["red fish blue fish", "blue", "", None, "one red red unknown"]
    cells = np.array(sorted({c for t in texts_[:2] for c in toxicity.terms_of(t)}))
    m = toxicity.Machine(cells, -0.3, rng.normal(size=len(cells)), rng.normal(size=(len(cells), 3)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(brute.frame(spark, list(enumerate(texts_))), m).collect()}
    for i, t in enumerate(texts_):
        at = [int(k) for k in np.flatnonzero(np.isin(cells, toxicity.terms_of(t)))]
        z = m.bias + sum(m.w[k] for k in at) + sum(m.v[a] @ m.v[b] for n, a in enumerate(at) for b in at[:n])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_places_of_very_many_terms_in_a_text(spark):
    """Slots give each word its own class; only the terms told to a text are placed; no terms give no spans."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(2000)]
    told = [(w, None if i % 3 else w[:3] + "*") for i, w in enumerate(words) if i % 2]
    text = ", ".join(w.upper() for w in words) + " é😀 " + " ".join(words)
    df = spark.createDataFrame([(text, told), ("plain text", told[:1]), ("", None)], "text string, told array<struct<term:string,general:string>>")
    got = [r[0] for r in df.select(pii.term_spans(pii.F.col("text"), pii.F.col("told"))).collect()]
    known, want = dict(told), []
    for m in pii_words.finditer(text):
        if m[0].lower() in known:
            general = known[m[0].lower()]
            want.append(("generalised" if general else "removed", m.start(), m.end(), general or ""))
    assert list(map(tuple, got[0])) == want and got[1] == [] and got[2] is None


def test_toxicity_is_fitted_away_from_the_driver(spark):
    """The driver gets the machine alone, not the terms of the documents that it is fitted on."""
    rnd = random.Random(3)
    words = ["".join(x) for x in itertools.product("abcdefghijkl", repeat=4)]
    rows = [(i, " ".join([*rnd.sample(words, 1000), *["idiot"] * (i % 3 == 0)])) for i in range(1000)]
    docs, labels = brute.frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    m = toxicity.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(m.cells) and m.w.shape == m.cells.shape and peak < 4e6  # the terms of 800 documents alone, four bytes each: 6.4e6


def test_machine_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 300, rng.integers(0, 40))) * 7 for _ in range(600)]
    y = np.array([float(21 in r or (35 in r) == (70 in r)) for r in rows])
    made = []
    for block in (1 << 20, 13):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        made.append(toxicity.train(np.arange(300) * 7, rows, y))
    assert len(made[0].cells) and np.array_equal(made[0].cells, made[1].cells) and np.array_equal(made[0].v, made[1].v)
