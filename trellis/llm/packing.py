"""Best-fit packing with large-item matching.

Documents become token ids with an end mark; those longer than a sequence are cut into full pieces after a shorter first
one. Pieces of one length are interchangeable, so the plan is made from how many pieces there are of each length:

1. full pieces have a sequence each;
2. pieces above a third of the capacity share a sequence with at most one other such piece: from the longest on, each
   takes the longest partner that fits;
3. smaller pieces, from the longest on, go to the sequence with the least gap that holds them (best fit); new sequences
   are opened where there is none.

A plan has as many entries as there are lengths, a few times over, whatever the number of documents. Pieces get ranks
among those of their length (counted within hashed shares first, so that no length meets in one task), and a rank and
a length give a sequence and a place in it by a search in the plan.

A null text is empty and has the end mark only. Ids may be null or repeated: each row is packed as a document of its
own. Extra columns are ignored; an empty table gives no rows. Rows equal in every column may swap places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import tokens
from trellis.storage import Scratch

CAPACITY, END = 1024, 2
#: hashed shares of each length within which pieces are ranked; with the capacity it bounds what the driver gets
SHARES = 256
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def bounds(n: int, capacity: int) -> list[int]:
    """Where pieces of n ids begin, and n: only the first may be short."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n + 1, capacity)]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and the ids themselves where asked for."""
    spec = tokens.read(path)
    shared = documents.sparkSession.sparkContext.broadcast((spec, tokens.ranks(spec)))
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.held(tokens.ByteIds, *shared.value)
        for batch in batches:
            row, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)  # noqa: B023

            for r, t in enumerate(batch.column(1)):
                data = encoder.encode(t.as_py() or "") + mark
                at = bounds(len(data) // 4, capacity)
                for k in range(len(at) - 1):
                    own = data[4 * at[k] : 4 * at[k + 1]]
                    row.append(r), piece.append(k), start.append(at[k]), length.append(at[k + 1] - at[k]), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                size += with_ids * len(data)
                if size > 16 << 20:
                    yield made()
                    row, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0
            yield made()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, _PIECE.format(id=kind) + ", ids array<long>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, how many of it), ..]) for the number of pieces of each length."""
    left = {k: v for k, v in counts.items() if v}
    full = left.pop(capacity, 0)
    done = [(full, [(capacity, 1)])] if full else []
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]

    def put(n: int, runs: list[tuple[int, int]]) -> None:
        gaps[capacity - sum(a * b for a, b in runs)].append((n, runs))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        for y in large:
            if not left[x]:
                break
            if x + y > capacity or y > x or not left[y] or (x == y and left[x] < 2):
                continue
            n = left[x] // 2 if x == y else min(left[x], left[y])
            left[x] -= n
            left[y] -= n
            put(n, [(x, 2)] if x == y else [(x, 1), (y, 1)])
        if left[x]:
            put(left[x], [(x, 1)])
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n, gap = left[s], s
        while n:
            while gap < capacity and not gaps[gap]:
                gap += 1
            m, runs = gaps[gap].pop() if gap < capacity else (n, [])
            each = gap // s
            whole, rest = min(m, n // each), n % each
            if whole:
                put(whole, [*runs, (s, each)])
            n -= whole * each
            m -= whole
            if m and n:  # fewer are left than one sequence takes
                put(1, [*runs, (s, rest)])
                n, m = 0, m - 1
            if m and runs:
                gaps[gap].append((m, runs))
    return done + [x for of_gap in gaps for x in of_gap]


def _intervals(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length << 44 | first rank, first sequence, offset, pieces a sequence), in order of the first."""
    out, used, first = [], {}, 0
    for n, runs in made:
        offset = 0
        for length, each in runs:
            out.append((length << 44 | used.get(length, 0), first, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        first += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = Scratch(spark, "packing").table(cut.select(*names).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARES)).cast("int")), "pieces")
    counted = held.groupBy("length", "share").count().collect()  # capacity * SHARES rows at most
    before = np.zeros((capacity + 1, SHARES), np.int64)
    for length, share, n in counted:
        before[length, share] = n
    totals = before.sum(1)
    before = np.cumsum(before, 1) - before
    table = _intervals(plan({i: int(n) for i, n in enumerate(totals) if n}, capacity))
    shared = spark.sparkContext.broadcast((before, table))
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        for batch in batches:
            length, share, nth = (batch.column(c).to_numpy() for c in ("length", "share", "nth"))
            rank = before[length, share] + nth - 1
            row = table[np.searchsorted(table[:, 0], length << 44 | rank, "right") - 1] if len(length) else np.zeros((0, 4), np.int64)
            past = rank - (row[:, 0] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 1] + past // np.maximum(row[:, 3], 1)), pa.array(row[:, 2] + past % np.maximum(row[:, 3], 1) * length)], names=[*names, "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long")
    return held.withColumn("nth", nth).mapInArrow(run, _PIECE.format(id=kind) + ", sequence_id long, offset long")


def packed_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(pieces(documents, path, capacity, end, doc_id, text), capacity)
