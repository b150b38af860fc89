"""MinHash near-duplicates by one-permutation hashing.

1. One pass takes each document's set of word shingles to a sketch: the least hash in each of `bands * rows` bins of one
   permutation, empty bins filled from bins drawn by a hash of (bin, attempt), the same for all documents (optimal
   densification). `rows` bins make a band.
2. Documents with equal sets are one class, whose smallest id goes on; copies need no pairs.
3. The members of a bucket (equal band) are compared with one centre, so that pairs grow with members, not their square.
   The centre is the member whose buckets are largest, most often the text that the others were made from; so buckets of
   one family have one centre, and their members are one group. Links are confirmed on full shingle sets, and linked
   documents become components.
4. In a group that still holds several components, further links are found by what members differ in. With the centre's
   set C, let d(x) be the symmetric difference of x and C, and p the percentage. Then x and y are linked just if

       |d(x) & d(y)| >= (u(x) + u(y)) / 2,   u(x) = |d(x)| - |x| * (100 - p) / (100 + p),

   as |d(x) ^ d(y)| = |x ^ y|. One of two documents of different components is not linked with the centre, so its u is
   above |C| * (100 - p) / (100 + p), and about half of d(x) has to be in d(y). Differences are joined by a prefix filter
   with the group's rarest elements first: edits of one document alone, which are most of them, join with nothing. Every
   pair of a group that could join two components is found so, exactly; none within a component is made.
5. Components spread the smallest id by joins with pointer jumping; nothing is gathered in one place.

Null or blank texts have empty sets and are linked with nothing, as are rows with a null id (their component is null).
Rows that share an id are one document; so any text of it links it. Ties go to the smaller id, in the order of its type,
which may be any that Spark orders. Extra columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import words as W
from trellis.storage import Scratch

BANDS, ROWS = 24, 6
#: copies of a row that a join on a possibly hot class is dealt over
SALTS = 16
_SKETCH = "doc_id {id}, n_shingles long, set1 long, set2 long, bands array<long>"


def _donors(bins: int, attempts: int = 256) -> np.ndarray:
    """For each bin, the bins it borrows from, in order; the last resort is every bin in turn."""
    drawn = np.random.Generator(np.random.PCG64(29)).integers(0, bins, (bins, attempts))
    return np.concatenate([drawn, (np.arange(bins)[:, None] + np.arange(bins)) % bins], axis=1)


def _densified(found: np.ndarray, filled: np.ndarray, donors: np.ndarray) -> np.ndarray:
    empty = np.flatnonzero(~filled)
    out, step = found.copy(), 0
    while len(empty):
        got = filled[donors[empty, step]]
        out[empty[got]] = found[donors[empty[got], step]]
        empty, step = empty[~got], step + 1
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer than k words are one shingle."""
    for i, j, buf, offsets in W.chunks(texts):
        low = W.lower(buf)
        starts, ends = W.spans(low, offsets, W.NONSPACE)
        bounds = W.by_document(starts, offsets)
        h = W.hashes(low, starts, ends)
        all_grams = W.grams(h, k)
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            yield i + d, np.unique(all_grams[a : b - k + 1]) if b - a >= k else W.grams(h[a:b], int(b - a)) if b > a else h[:0]


def sketches(documents: DataFrame, k: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = bands * rows
        donors = _donors(bins)
        salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, one, two, keys = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64), []
            for row, s in shingle_sets(batch.column(1), k):
                n[row] = len(s)
                if not len(s):
                    keys.append(None)
                    continue
                one[row], two[row] = s.sum(), W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                at = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                found, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
                found[at[first]], filled[at[first]] = s[first], True
                if len(first) < bins:
                    found = _densified(found, filled, donors)
                keys.append(W.mix((found.reshape(bands, rows) * W.GRAM[:rows]).sum(1) + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set1", "set2", "bands"])
        W.release()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SKETCH.format(id=kind))


def marked(documents: DataFrame, ids: DataFrame, doc_id: str, how: str) -> tuple[DataFrame, Column, list[str]]:
    """documents joined with a bitmap of ids(id), a column that is true for every row whose id is among them and for few
    others, and the names of added columns. The bitmap takes 4 MB, whatever the number of ids, and is broadcast."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 25))
    part, at = (lambda c: F.shiftright(bit(c), 15).cast("int")), (lambda c: bit(c).bitwiseAND(F.lit(32767)))
    tag = f"_{uuid.uuid4().hex}"
    bits = ids.groupBy(part("id").alias(f"{tag}_part")).agg(F.bitmap_construct_agg(at("id")).alias(f"{tag}_bits"))  # 1024 rows of 4 KB
    near = documents.withColumns({f"{tag}_part": part(F.col(doc_id)), f"{tag}_at": at(F.col(doc_id)).cast("int")}).join(F.broadcast(bits), f"{tag}_part", how)
    byte = F.conv(F.hex(F.expr(f"substring({tag}_bits, shiftright({tag}_at, 3) + 1, 1)")), 16, 10).cast("int")
    return near, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, {tag}_at & 7)")) != 0, F.lit(False)), [f"{tag}_part", f"{tag}_at", f"{tag}_bits"]


def of_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of documents(id, text) whose id is among ids(id), which are distinct; the bitmap drops most other rows before
    texts are shuffled."""
    near, may, _ = marked(documents, ids, "id", "inner")
    # an inner join with distinct ids: a semi-join would be pushed below the bitmap and shuffle every text
    return near.where(may).select("id", "text").join(ids, "id")


def compared(pairs: DataFrame, documents: DataFrame, k: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b, ..) with the sizes a_n and b_n of their full shingle sets, sums a_t and b_t that tell sets apart,
    `both`, the number of shingles that both have, and where asked `d`, the shingles that only one of them has. Ids with
    several texts give a row for each two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("text_a"), batch.column("text_b")
            held = {}
            for column in (first, second):
                fresh = [t for t in column.dictionary_encode().dictionary.to_pylist() if t not in held]
                for row, s in shingle_sets(pa.array(fresh, pa.large_string()), k):
                    held[fresh[row]] = s
            out, apart = np.zeros((5, len(batch)), np.int64), []
            for r, (x, y) in enumerate(zip(first.to_pylist(), second.to_pylist(), strict=True)):
                p, q = held[x], held[y]
                merged = np.concatenate([p, q])
                merged.sort()
                again = merged[1:] == merged[:-1]
                out[:, r] = len(p), len(q), p.sum().view(np.int64), q.sum().view(np.int64), again.sum()
                if differences:
                    apart.append(merged[~(np.append(again, False) | np.insert(again, 0, False))].view(np.int64))
            extra = [pa.array(apart, pa.list_(pa.int64()))] if differences else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, out), *extra], names=[*names, *added])
            del first, second, held, fresh, apart, extra
        W.release()

    names, added = pairs.columns, ["a_n", "b_n", "a_t", "b_t", "both", *(["d"] if differences else [])]
    texts = of_ids(documents, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    made = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema), *(f"{n} {'array<long>' if n == 'd' else 'long'}" for n in added)])
    return pairs.join(one, "a").join(two, "b").select(*names, "text_a", "text_b").mapInArrow(run, made)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id it reaches."""
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    label = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "label")
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        moved = scratch.table(least.join(up, "component").select("id", "old", F.least("component", "up").alias("component")), "label")
        done = moved.where("old <> component").isEmpty()
        scratch.drop(label)
        label = moved.select("id", "component")
        label._trellis_path = moved._trellis_path
        if done:
            scratch.drop(both)
            return label


def _linked(percent: int) -> Column:
    both = F.col("both")
    return (both > 0) & (100 * both >= percent * (F.col("a_n") + F.col("b_n") - both))


def groups(headed: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each document b that shares a bucket with others, with the centre a of that bucket."""
    member = headed.where("bands IS NOT NULL").select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("bucket", "m")
    shared = scratch.table(member.join(sizes, "bucket"), "shared")
    weight = shared.groupBy("id").agg(F.sum("m").alias("weight"))
    order = F.struct("weight", F.xxhash64("id").alias("by"), "id")
    centres = shared.join(weight, "id").groupBy("bucket").agg(F.max(order).alias("c")).select("bucket", F.col("c.id").alias("a"))
    return shared.join(centres, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def across(met: DataFrame, label: DataFrame, documents: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members of one group and different components that have enough differences from the group's centre
    in common by the prefix filter; a superset of those that are linked, and few others."""
    own = met.select("a", "b").distinct().union(met.select("a", F.col("a")).distinct())
    own = own.join(label.withColumnRenamed("id", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    kinds = own.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("centre")).where("low <> high").select("a", "centre")
    open_ = scratch.table(own.where("a <> b").join(kinds, "a").select("a", "b", "component", (F.col("component") != F.col("centre")).alias("out")), "open")
    over, under = 100 + percent, 100 - percent
    s = F.col("a_n") + F.col("b_n") - 2 * F.col("both")
    # a group is a centre with one text, a member is an id with one text
    element = compared(open_, documents, k, True).select(F.struct("a", "a_t").alias("group"), F.struct("b", "b_t").alias("member"), "component", "out", "a_n", s.alias("s"), (over * s - under * F.col("b_n")).alias("u"), F.explode("d").alias("e"))
    element = scratch.table(element, "differences")
    # an element of one component alone is shared by no pair that matters
    often = element.groupBy("group", "e").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group", "e", "f")
    of_one = Window.partitionBy("group", "member")
    placed = element.join(often, ["group", "e"]).withColumn("p", F.col("s") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("f", "e")))
    # what u of any partner is above: for members of the centre's component, u of one that is not linked with the centre
    other = F.when(F.col("out"), 2 * percent - under * F.col("a_n")).otherwise(under * F.col("a_n"))
    placed = placed.where((F.col("p") - 1 - F.col("s")) * (2 * over) + F.col("u") + other <= 0)
    placed = scratch.table(placed.select("group", "e", "member", "component", "out", "s", "u", "p"), "prefixes")
    x, y = placed.where("out"), placed.select("group", "e", *(F.col(c).alias(f"y_{c}") for c in ("member", "component", "out", "s", "u", "p")))
    least = F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("y_u")) / (2.0 * over)))
    fits = (F.col("component") != F.col("y_component")) & (~F.col("y_out") | (F.col("member") < F.col("y_member"))) & (F.col("p") + least <= F.col("s") + 1) & (F.col("y_p") + least <= F.col("y_s") + 1)
    found = scratch.table(x.join(y, ["group", "e"]).where(fits).select(F.col("member.b").alias("a"), F.col("y_member.b").alias("b")).distinct(), "pairs")
    scratch.drop(open_, element, placed)
    return found


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(documents.sparkSession, "near-dup")
    sketch = scratch.table(sketches(documents, k, bands, rows, doc_id, text), "sketch")
    sets = ["n_shingles", "set1", "set2"]
    copies = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    copies = copies.select(*sets, "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sketch.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    headed = salted.join(copies, [*sets, "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("head", "doc_id")).otherwise(F.col("doc_id")).alias("head"), "bands")
    headed = scratch.table(headed.withColumn("bands", F.when((F.col("head") == F.col("doc_id")) & (F.col("n_shingles") > 0), F.col("bands"))), "headed")
    scratch.drop(sketch)

    pairs = scratch.table(groups(headed, scratch), "pairs")
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    own = scratch.table(of_ids(own, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "texts")  # all that is ever compared
    met = scratch.table(compared(pairs, own, k), "met")
    first = components(scratch.table(met.where(_linked(percent)).select("a", "b").distinct(), "links"), scratch)
    further = across(met, first, own, k, percent, scratch)
    more = scratch.table(compared(further, own, k).where(_linked(percent)).select("a", "b").distinct(), "links")
    # these link components, so the components are what is joined
    at = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    between = more.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joint = components(scratch.table(between, "across"), scratch).select(F.col("id").alias("component_id"), F.col("component").alias("to"))
    scratch.drop(pairs, own, met, further, more)  # the result reads what is left
    named = first.select(F.col("id").alias("head"), "component")
    out = headed.select("doc_id", "n_shingles", "head").join(named, "head", "left").select("doc_id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    out = out.join(joint, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("to", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The documents that are kept, with their columns. Of rows that share a kept id, all stay."""
    scratch = Scratch(documents.sparkSession, "near-dup-gone")
    gone = scratch.table(near_duplicates(documents, k, percent, doc_id=doc_id, text=text, **how).where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    near, may, added = marked(documents, gone, doc_id, "left")
    # texts whose id is not in the bitmap stay where they are
    doubtful = near.where(may).drop(*added).alias("own").join(gone.alias("gone"), F.col(f"own.{doc_id}") == F.col("gone.id"), "left_anti")
    return near.where(~may).drop(*added).union(doubtful)
