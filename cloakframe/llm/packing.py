"""Bulk-synchronous best-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into whole sequences and a rest. The rests and the gaps of the open sequences
are range-sorted together by size, largest first. Each partition sweeps its rows: a gap is pushed, a document takes the
gap pushed last, which is its successor, the smallest free gap that holds it. What a partition cannot match is resolved
by rank between partitions from their counts alone, and those documents and gaps are joined on the slot number. Gaps are
updated and the round repeats until few documents find a gap. As a gap takes one document a round, the rest is filled
otherwise: gaps and documents that can still meet are dealt to tasks by a hash, where gaps take as many as they hold, in
turn with rounds, until no document fits any gap. Only those open new sequences, by best fit within partitions.
Every round is a table in the shared folder; the driver sees two counts a partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TOGETHER, Encoder, Vocabulary
from .common import bound_batches, discard, load, materialize

CAPACITY, END_ID = 4096, 1
GAP, DOCUMENT, PLACED = 0, 1, 2
#: Rows of a sweep's partition, about; sequences that one task opens in the end; share of documents below which
#: gaps and documents are dealt to tasks after a round.
ROWS, OPENED, WORTH = 20_000, 2000, 0.02
STATE = "part int, kind int, id long, size int, rank long, bin long, gap int"
FILLED = "kind int, id long, size int, bin long, gap int"


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 (and ids): each document's tokens and end id, cut at `capacity`.

    Null texts are empty: one piece that holds the end id alone. uid numbers the pieces.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = Encoder(shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                whole = [x + end for x in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                cuts = [range(0, len(x), width) for x in whole]
                owner = pa.array([k for k, c in enumerate(cuts) for _ in c], pa.int32())
                each = [x[a : a + width] for x, c in zip(whole, cuts, strict=True) for a in c]
                columns = [
                    pa.array(range(uid, uid + len(each)), pa.int64()), part.column(0).take(owner), pa.array([k for c in cuts for k in range(len(c))], pa.int32()),
                    pa.array([a // 4 for c in cuts for a in c], pa.int64()), pa.array([len(x) // 4 for x in each], pa.int64()), pa.array(map(zlib.crc32, each), pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, np.int32) for x in each], pa.list_(pa.int32())))
                uid += len(each)
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return materialize(rows.mapInArrow(run, schema), "pieces")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted gaps and documents of one partition; the rest is ranked, documents in order, gaps as stacked."""
    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    waiting = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "id", "size", "rank", "bin", "gap"])

    for b in batches:
        out = []
        for kind, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == GAP:
                stack.append((at, size))
            elif stack:
                bin_, gap = stack.pop()
                out.append((part, PLACED, at, size, None, bin_, gap))
            else:
                out.append((part, DOCUMENT, at, size, waiting, None, None))
                waiting += 1
        if out:
            yield batch(out)
    for i in range(0, len(stack), 10_000):
        yield batch([(part, GAP, at, size, i + k, None, None) for k, (at, size) in enumerate(stack[i : i + 10_000])])


def _resolve(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Which ranks of which partition's waiting documents meet which stacked gaps: rows (part, low, high, slot, step).

    counts: part, documents, gaps. A row's slot belongs to its rank `low` and goes up (step 1) or, for gaps, belongs to
    the last rank, since the last stacked gap is taken first.
    """
    free: list[list[int]] = []
    docs, gaps, slot = [], [], 0
    for part, waiting, stacked in sorted(counts):
        low = 0
        while low < waiting and free:
            owner, first, last = free[-1]
            n = min(waiting - low, last - first)
            docs.append((part, low, low + n, slot))
            gaps.append((owner, last - n, last, slot))
            slot, low = slot + n, low + n
            free[-1][2] -= n
            if free[-1][2] == first:
                free.pop()
        if stacked:
            free.append([part, 0, stacked])
    return docs, gaps


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit, longest first, of one task's documents into its gaps; a gap takes as many as it holds."""
    docs, gaps = [], []
    for b in batches:
        for kind, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            (gaps if kind == GAP else docs).append((size, at))
    gaps.sort()
    out = []
    for size, at in sorted(docs, key=lambda d: (-d[0], d[1])):
        k = bisect_left(gaps, (size, -1))
        if k == len(gaps):
            out.append((DOCUMENT, at, size, None, None))
            continue
        gap, bin_ = gaps.pop(k)
        out.append((PLACED, at, size, bin_, gap))
        if gap > size:
            insort(gaps, (gap - size, bin_))
    out += [(GAP, bin_, size, None, None) for size, bin_ in gaps]
    for i in range(0, len(out), 10_000):
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 10_000], strict=True), kinds, strict=True)], names=["kind", "id", "size", "bin", "gap"])


def _open(batches: Iterator[pa.RecordBatch], base: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Best fit, longest first, into sequences that this task opens."""
    docs = sorted((-s, i) for b in batches for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    gaps: list[tuple[int, int]] = []
    new = base + (TaskContext.get().partitionId() << 33)
    out: list[tuple[int, int, int]] = []
    for size, at in docs:
        k = bisect_left(gaps, (-size, -1))
        if k < len(gaps):
            gap, bin_ = gaps.pop(k)
        else:
            gap, bin_, new = capacity, new, new + 1
        out.append((at, bin_, capacity - gap))
        if gap + size:
            insort(gaps, (gap + size, bin_))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["uid", "sequence_id", "offset"])


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """uid, sequence_id, offset for every row of `items` (uid long, unique; size int, from 1 to capacity)."""
    spark = items.sparkSession
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    waiting, opened = total["n"], -(-total["tokens"] // capacity)
    docs = items.select(F.lit(DOCUMENT).alias("kind"), F.col("uid").alias("id"), F.col("size").cast("int").alias("size"))
    state = docs.unionByName(spark.range(opened).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).alias("size")))
    rows, done, aside, dealing = waiting + opened, [], [], False
    took = lambda t: t.filter(F.col("kind") == PLACED).select(F.col("id").alias("uid"), F.col("bin").alias("sequence_id"), (capacity - F.col("gap")).cast("long").alias("offset"))
    while waiting:
        if dealing:  # only what can still meet: gaps never grow
            is_gap = F.col("kind") == GAP
            least, most = state.agg(F.min(F.when(~is_gap, F.col("size"))), F.max(F.when(is_gap, F.col("size")))).first()
            if most is None or least > most:
                break
            aside.append(state.filter(~is_gap & (F.col("size") > most)))
            state = state.filter(F.when(is_gap, F.col("size") >= least).otherwise(F.col("size") <= most))
            tasks = -(-state.count() // ROWS)
            dealt = state.repartition(1) if tasks == 1 else state.repartition(tasks, F.xxhash64(F.lit(len(done)), "kind", "id"))
            table = materialize(dealt.select("kind", "id", "size").mapInArrow(_fill, FILLED), "filled")
            done.append(took(table))
            state = table.filter(F.col("kind") != PLACED).select("kind", "id", "size")
            kinds = {r["kind"]: r["count"] for r in state.groupBy("kind").count().collect()}
            waiting, rows = kinds.get(DOCUMENT, 0), sum(kinds.values())
            if tasks == 1 or not waiting:  # one task saw all: nothing fits any more
                break
        order = [F.desc("size"), F.asc("kind"), F.asc("id")]
        swept = state.repartitionByRange(max(4, -(-rows // ROWS)), *order).sortWithinPartitions(*order)
        swept = materialize(swept.select("kind", "id", "size").mapInArrow(_sweep, STATE), "swept")
        tally: dict[int, list[int]] = {}
        matched = 0
        for r in swept.groupBy("part", "kind").count().collect():
            if r["kind"] == PLACED:
                matched += r["count"]
            else:
                tally.setdefault(r["part"], [0, 0])[r["kind"] == GAP] = r["count"]
        pairs = _resolve([(p, d, g) for p, (d, g) in tally.items()])
        slotted = []
        for kind, meets in zip((DOCUMENT, GAP), pairs, strict=True):
            ranges = spark.createDataFrame(meets, "at int, low long, high long, slot long")  # at most two for each partition
            slot = F.col("slot") + (F.col("rank") - F.col("low") if kind == DOCUMENT else F.col("high") - 1 - F.col("rank"))
            side = swept.filter(F.col("kind") == kind).join(F.broadcast(ranges), (F.col("part") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
            slotted.append(side.select("id", "size", slot.alias("slot")))
        d, g = (s.filter("slot is not null").select("slot", F.col("id").alias(f"{n}_id"), F.col("size").alias(f"{n}_size")) for s, n in zip(slotted, "dg", strict=True))
        placed = d.join(g, "slot").select(F.lit(PLACED).alias("kind"), F.col("d_id").alias("id"), F.col("d_size").alias("size"), F.col("g_id").alias("bin"), F.col("g_size").alias("gap"))
        empty = [F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("gap")]
        rest = [s.filter("slot is null").select(F.lit(k).alias("kind"), "id", "size", *empty) for s, k in zip(slotted, (DOCUMENT, GAP), strict=True)]
        table = swept.filter(F.col("kind") == PLACED).select("kind", "id", "size", "bin", "gap").unionByName(placed).unionByName(rest[0]).unionByName(rest[1])
        table = materialize(table, "round")
        discard(swept)
        matched += sum(h - l for _, l, h, _ in pairs[0])
        done.append(took(table))
        dealing = dealing or matched < max(1, WORTH * waiting)
        waiting, rows = waiting - matched, rows - matched
        left = table.filter(F.col("kind") == DOCUMENT).select("kind", "id", "size")
        gaps = table.filter(F.col("kind") == PLACED).select(F.lit(GAP).alias("kind"), F.col("bin").alias("id"), (F.col("gap") - F.col("size")).alias("size")).filter("size > 0")
        state = left.unionByName(table.filter(F.col("kind") == GAP).select("kind", "id", "size")).unionByName(gaps)
    left = state.filter(F.col("kind") == DOCUMENT)
    for late in aside:
        left = left.unionByName(late)
    if tokens := left.agg(F.sum("size")).first()[0]:
        dealt = left.select("id", "size").repartition(-(-tokens // (capacity * OPENED)), F.xxhash64("id"))
        done.append(materialize(dealt.mapInArrow(lambda b: _open(b, opened, capacity), "uid long, sequence_id long, offset long"), "opened"))
    out = spark.createDataFrame([], "uid long, sequence_id long, offset long")
    for part in done:
        out = out.unionByName(part)
    return out


def packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts are empty: one piece with the end id alone. Repeated rows are packed as often as they stand; null ids
    stay; an empty table gives no rows.
    """
    cut = pieces(docs, path, doc_id, text, capacity, end_id, ids)
    short = cut.filter(F.col("length") < capacity)
    places = pack(short.select("uid", F.col("length").cast("int").alias("size")), capacity)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids]
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    return full.select(*cols).unionByName(short.join(places, "uid").select(*cols))


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, **kinds: str) -> DataFrame:
    """sequence_id, ids: the token ids of every packed sequence, at most `capacity` of them."""
    parts = packed(docs, path, capacity=capacity, ids=True, **kinds).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
