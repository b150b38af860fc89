"""Benchmark decontamination by winnowing.

A window is `n` successive words of an item (a shorter item is one window of all its words). Of each window of L words,
documents and items keep as fingerprint the k-gram of least hash, k = (L + 1) // 2, the first of equals; windows that lie
side by side mostly share theirs, so about two of every L - k + 2 places are kept. Two texts that share L words in a row
keep the same k-gram of them, so no shared window goes unseen. Fingerprints of documents are joined to the benchmark's by
their words, and each hit is extended to both sides while words agree; where it comes to L words or more, all of them
are hit, as every window that lies in them has its fingerprint there.

Fingerprints of the benchmark set bits of a bitmap, which is all that is broadcast; it drops most of the documents' before
they are shuffled. It has 16 bits for each, up to 2 ** 27 (16 MB); beyond that it lets more through, and nothing is lost.

Null or wordless texts have no words and no hits. Rows with equal id and text get equal results, one for each row; rows
that share an id but differ in text are told apart by a digest. Items with a null id or without words count for nothing;
rows of one item id are one item with several texts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import words as W
from trellis.storage import Scratch

#: least and most bits of the bitmap, as powers of two, and how many for each fingerprint
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16

_CONTEXT = "len int, gram string, before array<string>, after array<string>"
_PRINTS = f"item string, {_CONTEXT}, print long"
_HITS = f"id {{id}}, digest string, n_words long, pos long, {_CONTEXT}"


def fingerprints(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-grams that windows of `length` words within one document keep, and their hashes."""
    k = (length + 1) // 2
    g = W.grams(h, k)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - k + 1):
        lower = g[j : j + n] < least
        least[lower], at[lower] = g[j : j + n][lower], j
    places = np.unique((at + np.arange(n))[doc[:n] == doc[length - 1 :]])
    return places, g[places]


def _context(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> list[pa.Array]:
    """The k-grams at these places, and the words before (nearest first) and after them that a window could reach."""
    k, grams, before, after = (length + 1) // 2, [], [], []
    for p in at.tolist():
        low_at, high_at = max(int(bounds[doc[p]]), p - length + k), min(int(bounds[doc[p] + 1]), p + length)
        w = [low[starts[i] : ends[i]].tobytes().decode() for i in range(low_at, high_at)]
        m = p - low_at
        grams.append(" ".join(w[m : m + k])), before.append(w[:m][::-1]), after.append(w[m + k :])
    return [pa.array(np.full(len(at), length, np.int32)), pa.array(grams, pa.string()), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string()))]


def _read(texts: pa.Array) -> Iterator[tuple]:
    for i, j, buf, offsets in W.chunks(texts):
        low = W.lower(buf)
        starts, ends = W.spans(low, offsets, W.ALNUM)
        bounds = W.by_document(starts, offsets)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        yield i, low, starts, ends, bounds, doc, W.hashes(low, starts, ends)


def item_fingerprints(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each fingerprint of each item: item, len (of the windows), gram, before, after, print (its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, low, starts, ends, bounds, doc, h in _read(batch.column(1)):
                window = np.minimum(np.diff(bounds), n)
                for length in np.unique(window[window > 0]).tolist():
                    at, prints = fingerprints(h, doc, length)
                    keep = window[doc[at]] == length
                    at, prints = at[keep], prints[keep]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + doc[at])), *_context(low, starts, ends, bounds, doc, at, length), pa.array(prints.view(np.int64))], names=["item", "len", "gram", "before", "after", "print"])

    return benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(F.col(item_id).isNotNull()).mapInArrow(run, _PRINTS)


def bitmap(prints: DataFrame) -> np.ndarray:
    """Bits of the fingerprints, packed; built where the rows are, and sent here as rows of 4 KB, 4096 at most."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (prints.count() * BITS_EACH).bit_length()))
    bit = F.pmod(F.col("print"), F.lit(size))
    rows = prints.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    # the bucket of value v is 1 + v // 32768 for v > 0 and holds positions (v - 1) % 32768; 0 goes to bucket 0
    flags = np.zeros(size, bool)
    for bucket, bits in rows:
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little"))
        flags[((bucket - 1) * 32768 + 1 + found) % size if bucket > 0 else (-found) % size] = True
    return np.packbits(flags)


def document_fingerprints(documents: DataFrame, lengths: list[int], bits: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """One row with len 0 for each document, and one for each of its fingerprints whose bit is set."""
    shared = documents.sparkSession.sparkContext.broadcast((bits, lengths))
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lengths = shared.value
        mask = np.uint64(8 * len(packed) - 1)
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            for first, low, starts, ends, bounds, doc, h in _read(batch.column(2)):
                own = pa.array(np.arange(first, first + len(bounds) - 1))
                none = pa.array([[]] * len(own), pa.list_(pa.string()))
                yield _hits(ids, digests, own, np.diff(bounds), np.full(len(own), -1), [pa.array(np.zeros(len(own), np.int32)), digests.take(own).cast(pa.string()), none, none])
                for length in lengths:
                    at, prints = fingerprints(h, doc, length)
                    place = (prints & mask).astype(np.int64)
                    at = at[(packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                    if len(at):
                        yield _hits(ids, digests, pa.array(first + doc[at]), np.zeros(len(at), np.int64), at - bounds[doc[at]], _context(low, starts, ends, bounds, doc, at, length))

    return documents.select(F.col(doc_id), digest_of(F.col(text)).alias("digest"), F.col(text).cast("string")).mapInArrow(run, _HITS.format(id=kind))


def _hits(ids: pa.Array, digests: pa.Array, rows: pa.Array, n_words: np.ndarray, pos: np.ndarray, context: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(rows), digests.take(rows).cast(pa.string()), pa.array(n_words.astype(np.int64)), pa.array(pos.astype(np.int64)), *context], names=["id", "digest", "n_words", "pos", "len", "gram", "before", "after"])


def _agreeing(a: Column, b: Column) -> Column:
    """How many words the two arrays begin with alike."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1)


def extended(found: DataFrame, prints: DataFrame) -> DataFrame:
    """Documents' fingerprints joined to the benchmark's and extended: id, digest, n_words, low and high (the words that
    are hit), items. Rows of len 0 pass without a hit."""
    known = prints.groupBy("len", "gram", F.col("before").alias("i_before"), F.col("after").alias("i_after")).agg(F.collect_set("item").alias("items"))
    k = F.floor((F.col("len") + 1) / 2)
    left, right = _agreeing(F.col("before"), F.col("i_before")), _agreeing(F.col("after"), F.col("i_after"))
    met = found.join(known, ["len", "gram"], "left").withColumns({"l": left, "r": right})
    met = met.where((F.col("len") == 0) | (F.col("l") + k + F.col("r") >= F.col("len")))
    return met.select("id", "digest", "n_words", (F.col("len") == 0).alias("own"), (F.col("pos") - F.col("l")).alias("low"), (F.col("pos") + k + F.col("r")).alias("high"), "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: id, digest (of its text), n_words, n_hit, n_items, items, contaminated."""
    prints = Scratch(documents.sparkSession, "decontaminate").table(item_fingerprints(benchmark, n, item_id, item_text), "prints")
    lengths = sorted(r[0] for r in prints.select("len").distinct().collect())  # n values at most
    met = extended(document_fingerprints(documents, lengths, bitmap(prints), doc_id, text), prints)
    whole = met.groupBy("id", "digest").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("own"), 1)).cast("int").alias("rows"), F.array_sort(F.collect_set(F.when(~F.col("own"), F.struct("low", "high")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # hits lie in order of their first word; `upto` is the end of what is covered so far
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "hits", F.struct(zero.alias("n"), zero.alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(zero, x["high"] - F.greatest(a["upto"], x["low"]))).alias("n"), F.greatest(a["upto"], x["high"]).alias("upto")),
        lambda a: a["n"],
    )
    out = whole.select("id", "digest", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("hits") > 0).alias("contaminated"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows").withColumnRenamed("id", doc_id)


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def clean(documents: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their columns."""
    report = decontaminate(documents, benchmark, n, doc_id, text, **names)
    bad = report.where("contaminated").select(F.col(doc_id).alias("id"), "digest").distinct()
    same = F.col(f"own.{doc_id}").eqNullSafe(F.col("bad.id")) & (digest_of(F.col(f"own.{text}")) == F.col("bad.digest"))
    return documents.alias("own").join(bad.alias("bad"), same, "left_anti")
