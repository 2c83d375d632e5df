"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first four and five letters, hashed; a document has a term or not. The machine's
score is a bias, a weight for every term present, and for every pair present the product of their factor vectors, so
that pairs such as an insult with a group mention count beyond their single weights. It is fitted by AdaGrad on a
bounded sample of labelled documents, over every hashed term that tells the labels apart by more than chance, alone or
together with the other terms of its documents. The latter is sought in what the single terms leave unexplained, by a
random sketch of each document: its sum over a term's documents is far from zero when pairs with the term matter, even
if neither term tells anything alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, load, materialize
from .language import bucket

#: Labelled documents that the machine is fitted on, at most (about); hashed terms (the bound of the machine: CELLS times
#: FACTORS + 1 numbers of four bytes); factors.
SAMPLE, CELLS, FACTORS = 20_000, 1 << 21, 8
#: A term must stand in so many sample documents.
SUPPORT = 5
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 256, 0.15, 2e-4, 17
#: Standard deviations from chance by which a term counts, alone or in company, however many such terms there are; numbers
#: of a document's sketch; share of the documents from which on a term stands in it at full length.
EVIDENCE, SKETCH, COMMON = 6.0, 16, 0.05
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words remembered at a time.
MEMO = 300_000
#: Entries (a term of a document) that are summed at a time.
BLOCK = 1 << 20


def cells_of(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-case word."""
    h = xxhash.xxh64_intdigest
    return (h(word) % CELLS, *(h(f"{word[:k]}*") % CELLS for k in PREFIXES if len(word) >= k))


def terms_of(text: str | None) -> list[int]:
    """The hashed terms of a text, sorted, each once; null counts as empty."""
    return sorted({c for w in set(WORD.findall((text or "").lower())) for c in cells_of(w)})


@dataclass
class Machine:
    cells: np.ndarray  # sorted hashed terms that count
    bias: float
    w: np.ndarray
    v: np.ndarray  # terms x factors

    def score(self, ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-odds of documents given as term places, concatenated; n: terms of each document."""
        out = np.full(len(n), self.bias)
        some = n > 0
        if some.any():
            v, at = self.v[ids], starts[some]
            s = np.add.reduceat(v, at, axis=0)
            out[some] += np.add.reduceat(self.w[ids], at) + 0.5 * ((s**2).sum(1) - np.add.reduceat((v**2).sum(1), at))
        return out


def _sums(at: np.ndarray, n: int, x: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """For each of n places the sum of x[of] (without x: of ones) over the entries at it."""
    out = np.zeros(n)
    for i in range(0, len(at), BLOCK):
        b = slice(i, i + BLOCK)
        out += np.bincount(at[b], None if x is None else x[of[b]], n)
    return out


def _alone(flat: np.ndarray, doc: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """Standard deviations by which the labels of each term's documents differ from chance."""
    df, off = _sums(flat, terms), _sums(flat, terms, y - y.mean(), doc)
    return np.abs(off) / np.sqrt(np.maximum(df, 1) * max(y.mean() * (1 - y.mean()), 1e-9))


def _in_company(flat: np.ndarray, doc: np.ndarray, missed: np.ndarray, spread: np.ndarray, terms: int) -> np.ndarray:
    """The same for each term together with the others of its documents; missed: label less probability, spread: its variance."""
    n = len(missed)
    sums = lambda x: _sums(flat, terms, x, doc)
    size = np.sqrt(np.minimum(1, _sums(flat, terms) / n / COMMON))
    rng, told, single = np.random.default_rng(SEED), np.zeros(terms), sums(missed)
    for _ in range(SKETCH):
        part = size * rng.normal(size=terms)
        near = _sums(doc, n, part, flat)
        told += (sums(missed * near) - part * single) ** 2 / np.maximum(sums(spread * near**2), 1e-12)
    return (told - SKETCH) / np.sqrt(2 * SKETCH)


def train(cells: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Fits the machine over those of the sorted hashed terms `cells` that tell; rows: those that each document has."""
    flat = np.concatenate([*(np.searchsorted(cells, r).astype(np.int32) for r in rows), np.zeros(0, np.int32)])
    return _train(cells, flat, np.array([len(r) for r in rows], np.int64), y)


def _train(cells: np.ndarray, flat: np.ndarray, count: np.ndarray, y: np.ndarray) -> Machine:
    """The same; flat: places in `cells` of the documents' terms, count: terms of each document. Numbers of four bytes, of
    which there is one for every term of every document, are kept; wider ones are made for a block at a time."""
    doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
    if not len(cells) or not 0 < y.sum() < len(y):
        return _fit(cells, flat, doc, y, np.zeros(len(cells), bool))
    chosen = _alone(flat, doc, y, len(cells)) >= EVIDENCE
    first = _fit(cells, flat, doc, y, chosen)
    p = 1 / (1 + np.exp(-np.clip(_log_odds(first, *_only(flat, doc, len(y), chosen)), -30, 30)))
    more = _in_company(flat, doc, y - p, p * (1 - p) + 0.01, len(cells)) >= EVIDENCE
    return _fit(cells, flat, doc, y, chosen | more) if (more & ~chosen).any() else first


def _only(flat: np.ndarray, doc: np.ndarray, n: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the chosen terms of the documents' chosen terms, and how many each of n documents has."""
    held = chosen[flat]
    return (np.cumsum(chosen) - 1).astype(np.int32)[flat[held]], _sums(doc[held], n).astype(np.int64)


def _log_odds(m: Machine, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    parts = [slice(i, i + BATCH) for i in range(0, len(count), BATCH)]
    return np.concatenate([m.score(flat[ends[b][0] - count[b][0] : ends[b][-1]], np.cumsum(count[b]) - count[b], count[b]) for b in parts])


def _fit(cells: np.ndarray, flat: np.ndarray, doc: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> Machine:
    """AdaGrad over the chosen terms; flat, doc: term and document of every entry, by document."""
    n, pos = len(y), float(y.sum())
    prior = (pos + 0.5) / (n + 1.0)
    bias, cells = float(np.log(prior / (1 - prior))), cells[chosen]
    flat, count = _only(flat, doc, n, chosen)
    rng = np.random.default_rng(SEED)
    m = Machine(cells, bias, np.zeros(len(cells), np.float32), rng.normal(0, 0.05, (len(cells), FACTORS)).astype(np.float32))
    if not len(cells):
        return m
    gw, gv, gb = np.full(len(cells), 1e-8, np.float32), np.full(m.v.shape, 1e-8, np.float32), 1e-8
    starts = np.cumsum(count) - count
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            d = order[i : i + BATCH]
            c = count[d]
            at = np.cumsum(c) - c
            f = flat[np.repeat(starts[d] - at, c) + np.arange(c.sum())]
            z = m.score(f, at, c)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) / len(d)).astype(np.float32)
            gb += float(g.sum()) ** 2
            m.bias -= RATE * float(g.sum()) / gb**0.5
            if not len(f):
                continue
            v, each, s = m.v[f], np.repeat(g, c), np.zeros((len(d), FACTORS), np.float32)
            s[c > 0] = np.add.reduceat(v, at[c > 0], axis=0)
            pull = each[:, None] * (np.repeat(s, c, axis=0) - v)
            dw = np.bincount(f, weights=each, minlength=len(cells)).astype(np.float32) + DECAY * m.w
            dv = np.stack([np.bincount(f, weights=pull[:, j], minlength=len(cells)) for j in range(FACTORS)], 1).astype(np.float32) + DECAY * m.v
            gw += dw**2
            gv += dv**2
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * dv / np.sqrt(gv)
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fits on labelled documents whose bucket of 5 is not 0; of several labels for an id the largest counts.

    One task holds the terms of about SAMPLE documents and fits the machine over those of SUPPORT documents or more; the
    driver gets the machine alone. Null labels and null ids teach nothing, null texts have no terms, documents of equal
    terms and label count once.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y")).filter(bucket(F.col("id"), 5) != 0)
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxicity sample"), "id"), F.lit(1_000_000)) / 1e6 < share)  # about SAMPLE rows: small enough to broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["y", "terms"])

    listed = materialize(rows.mapInArrow(terms, "y int, terms array<int>").distinct(), "terms")  # copies teach once

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, parts, hs, ys = np.zeros(CELLS, np.int64), [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            h, y, lists = batch.columns
            flat = lists.flatten().to_numpy()
            df += np.bincount(flat, minlength=CELLS)
            parts += np.split(flat, np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1]) if len(lists) else []
            hs.append(h.to_numpy())
            ys.append(y.to_numpy().astype(float))
        h, y, known = np.concatenate(hs), np.concatenate(ys), df >= SUPPORT
        order, place = np.lexsort((y, h)), (np.cumsum(known) - 1).astype(np.int32)  # the same machine however rows are dealt
        flat, count, at = np.empty(df[known].sum(), np.int32), np.zeros(len(y), np.int64), 0
        for k, i in enumerate(order):
            row = place[parts[i][known[parts[i]]]]
            flat[at : at + len(row)], count[k], at = row, len(row), at + len(row)
        parts.clear()
        m = _train(np.flatnonzero(known), flat, count, y[order])
        floats = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.cells.astype(np.int32)], pa.list_(pa.int32())), pa.array([m.w], floats), pa.array([m.v.ravel()], floats)], names=["bias", "cells", "w", "v"])

    hashed = listed.select(F.xxhash64("terms", "y").alias("h"), "y", "terms")
    got = hashed.coalesce(1).mapInArrow(learn, "bias double, cells array<int>, w array<float>, v array<float>").toArrow()
    discard(listed)
    cells, w, v = (got[x].combine_chunks().flatten().to_numpy() for x in ("cells", "w", "v"))
    return Machine(cells.astype(np.int64), got["bias"][0].as_py(), w, v.reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the probability of label 1; null texts count as empty, which score as the bias alone."""
    bound_batches(docs.sparkSession)
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(machine)
    names = [*docs.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        place = {int(c): i for i, c in enumerate(m.cells)}  # of the sample's terms with support

        def places(w: str) -> tuple[int, ...]:
            if (got := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[w] = tuple(place[c] for c in cells_of(w) if c in place)
            return got

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [sorted({p for w in set(WORD.findall((t or "").lower())) for p in places(w)}) for t in part.column(at).cast(pa.string()).to_pylist()]
                n = np.array([len(x) for x in ids])
                z = m.score(np.array([p for x in ids for p in x], np.int64), np.concatenate(([0], np.cumsum(n)[:-1])).astype(int), n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Null and empty texts and those without known terms score as the bias alone. Repeated rows and null ids stay, long
    texts are scored whole, further columns of docs and labels are ignored whatever their names, an empty table gives no
    rows, and without labels of both kinds every score is the prior.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (bucket(F.col(doc_id), 5) == 0).alias("held_out"))
    scored = score(rows, fit(docs, labels, doc_id, text, label))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
