"""Language identification by multilingual mixture inference.

Every word of a document is drawn from one of the learned languages; its likelihood in each is the product of its
character trigrams' probabilities there. Expectation-maximisation estimates the document's language proportions, and
the set of languages is the prefix of the languages ordered by proportion with the best penalised likelihood
(log-likelihood less half the logarithm of the number of words for each language beyond the first).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, load

#: Trigrams are hashed to so many cells; so many languages, the most frequent ones, are learned.
CELLS, MAX_LANGUAGES = 1 << 16, 256
#: The classifier is fitted on about so many documents of each language, dealt by a hash of their id.
SAMPLE = 2000
ROUNDS, MAX_SET, SMOOTH = 12, 4, 0.5
#: Bytes of text handled at a time; a longer text is one batch of its own.
BATCH_BYTES = 250_000


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every trigram of all words, where each word's trigrams begin, and the number of words of each text."""
    joined = "".join(["  ", *(t.lower() + "  " for t in texts)])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    is_letter = letters[code]
    c = np.where(is_letter, code, np.uint32(32))
    inside = is_letter | np.concatenate(([False], is_letter[:-1]))
    begins = is_letter & ~np.concatenate(([False], is_letter[:-1]))
    at = np.flatnonzero(inside)
    cells = (c[at] * np.uint32(2654435761) + c[at - 1] * np.uint32(2246822519) + c[at - 2] * np.uint32(3266489917)) >> np.uint32(16)
    ends = 2 + np.cumsum([len(t.lower()) + 2 for t in texts])
    words = np.diff(np.concatenate(([0], np.cumsum(begins)[ends - 1]))) if texts else np.zeros(0, int)
    return cells.astype(np.int64), np.flatnonzero(begins[at]), words


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # cells x languages


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _em(r: np.ndarray, n: np.ndarray, starts: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and the log-likelihood beside the words' best; r: words x languages."""
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(ROUNDS):
        share = r * pi[doc]
        share /= share.sum(1, keepdims=True)
        pi = _sums(share, starts) / n[:, None]
    return pi, _sums(np.log(np.maximum((r * pi[doc]).sum(1), 1e-300)), starts)


def mixtures(texts: list[str], model: Model, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages, zero outside the chosen set) and the number of words of each text."""
    cells, begins, words = _grams(texts, letters)
    out = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(words)
    if not len(some):
        return out, words
    ll = _sums(model.logp[cells], begins).astype(np.float64)
    best = ll.max(1, keepdims=True)
    r, n = np.exp(np.maximum(ll - best, -60)), words[some]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    pi, _ = _em(r, n, starts, np.full((len(some), r.shape[1]), 1 / r.shape[1]))
    order = np.argsort(-pi, axis=1, kind="stable")
    single = _sums(ll - best, starts)
    top = single.argmax(1)
    value, chosen = single[np.arange(len(some)), top], np.zeros_like(pi)
    chosen[np.arange(len(some)), top] = 1
    mixed = np.flatnonzero(np.sort(pi, axis=1)[:, -2] > 0.5 / n) if pi.shape[1] > 1 else []
    for k in range(2, min(MAX_SET, pi.shape[1]) + 1) if len(mixed) else ():
        take = np.repeat(np.isin(np.arange(len(some)), mixed), n)
        start = np.zeros((len(mixed), pi.shape[1]))
        np.put_along_axis(start, order[mixed, :k], 1 / k, axis=1)
        m = n[mixed]
        sub, like = _em(r[take], m, np.concatenate(([0], np.cumsum(m)[:-1])), start)
        like = like - 0.5 * (k - 1) * np.log(m)
        better = like > value[mixed]
        value[mixed[better]], chosen[mixed[better]] = like[better], sub[better]
    out[some] = chosen
    return out, words


def _batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_BYTES together."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > BATCH_BYTES:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns the languages of the rows whose bucket of 4 is not 2, on a sample of about SAMPLE documents of each."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("id"), 4) != 2))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000)) / 1e6
    sample = rows.filter(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = _letters(), {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for i, j in _batches(pa.array(texts, pa.string())):
                    seen = np.bincount(_grams(texts[i:j], letters)[0], minlength=CELLS)
                    table[name] = table.get(name, 0) + seen
        for name, seen in table.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["lang", "cell", "n"])

    counted = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((CELLS, len(languages)))
    at = np.searchsorted(languages, counted["lang"].to_pylist())
    n[counted["cell"].to_numpy(), at] = counted["n"].to_numpy()
    return Model(languages, np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * CELLS)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", to: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """docs with the predicted language ('und' without letters or languages), its proportion, and the chosen set.

    Null texts count as empty: 'und' with score 0. Ties go to the language first in order. Other columns stay.
    """
    bound_batches(docs.sparkSession)
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    extra = [T.StructField(to[0], T.StringType()), T.StructField(to[1], T.DoubleType()), T.StructField(to[2], T.ArrayType(T.StringType()))]
    names = [*docs.columns, *to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = _letters(), shared.value
        for batch in batches:
            for i, j in _batches(batch.column(at)):
                pi, words = mixtures([t or "" for t in batch.column(at).slice(i, j - i).to_pylist()], model, letters)
                und = (words == 0) | (not model.languages)
                top = pi.argmax(1) if model.languages else np.zeros(j - i, int)
                lang = ["und" if u else model.languages[k] for u, k in zip(und, top, strict=True)]
                score = np.where(und, 0.0, np.clip(pi.max(1, initial=0.0), 0, 1))
                sets = [[model.languages[k] for k in np.flatnonzero(p > 0)] for p in pi]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages. An empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (bucket(F.col(doc_id), 4) == 2).alias("held_out"))
    return predict(rows, fit(docs, doc_id, text, lang)).select("doc_id", "held_out", "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs with letters and a language, or several of whatever proportions, with their columns."""
    to = fresh(docs, "lang_pred", "score", "languages")
    named = predict(docs.withColumn(text, F.col(text).cast("string")), fit(docs, doc_id, text, lang), text, tuple(to))
    return named.filter(F.col(to[0]) != "und").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))
