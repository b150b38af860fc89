"""LM scoring by masked pseudo-likelihood.

1. Every word of every document is counted, and whether it occurs in one document alone. The `top` commonest words are
   tokens of their own, the rest falls into hashed buckets. Tokens are dealt by rank to classes of equal size.
2. A network in numpy sees `window` tokens on both sides of a masked one (embedding, one hidden layer) and predicts the
   token: its class, and the token within its class, both from the hidden layer. It starts from the tokens' shares.
3. Training goes over all words once. Documents are dealt by a hash to `parts` and within them to shards of about `shard`
   words; shards of a part start from common weights and are averaged by numbers of words, part after part. Neither
   shards nor the order within them depend on how the input is partitioned, and averages are sums of whole numbers, so
   scores are the same however the table is laid out.
4. Within a bucket, a word that other documents have is one of the bucket's known words; one that no other document has
   is new to the model of all others, which gives all new words together the share that they have of rare words (deleted
   estimation). A document's words are so never evidence for themselves, and what is known grows with the corpus.
5. A document's score is the sum of log-probabilities of its words, each predicted from both of its sides.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; texts are read whole, windows end at texts'
ends. A null or wordless text has no tokens, log_prob 0 and mean 0, as has every text of a table without words. Rows are
scored one by one: ids may be null or repeated (rows of equal id and text count as one document where words are new),
extra columns are ignored. Ties in the vocabulary go to the lesser hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import words as W
from trellis.storage import Scratch

TOP, BUCKETS, CLASSES, WINDOW, DIM, HIDDEN = 2048, 64, 24, 2, 12, 24
#: sync points of the one pass, and words of a shard
PARTS, SHARD = 4, 1 << 20
#: words that are trained on at once, and scored at once
BATCH, SLICE = 2048, 1 << 15
RATE = 0.7
#: weights are summed as whole multiples of this
UNIT = 1 << 24


@dataclass(frozen=True)
class Known:
    """What the counts say of the words beyond the commonest."""

    n: int  # tokens of words
    rare: int  # of these, in buckets
    new: int  # of these, of words that one document alone has
    new_words: int


class Vocabulary:
    """Tokens 0.. are words by rank, then buckets, then the edge of a text."""

    def __init__(self, top: list[tuple[int, int]], buckets: list[tuple[int, int, int]], known: Known, n_buckets: int = BUCKETS, classes: int = CLASSES) -> None:
        """top: (hash, n) in order; buckets: (bucket, n, words that several documents have)."""
        hashes = np.array([h for h, _ in top], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.rank = hashes[order], order.astype(np.int32)
        size = len(top) + n_buckets
        count, words = np.zeros(size), np.ones(size)
        count[: len(top)] = [n for _, n in top]
        for b, n, d in buckets:
            count[len(top) + b], words[len(top) + b] = n, max(1, d)
        self.n_words, self.n_buckets, self.edge = len(top), n_buckets, size
        self.classes, self.members = classes, -(-size // classes)
        # by rank of count: class c has the tokens of ranks c * members and on
        by_count = np.argsort(-count, kind="stable")
        self.cls, self.slot = np.empty(size, np.int32), np.empty(size, np.int32)
        self.cls[by_count], self.slot[by_count] = np.arange(size) // self.members, np.arange(size) % self.members
        grid = np.zeros((classes, self.members))
        grid[self.cls, self.slot] = count + 0.5
        self.filled = grid > 0
        self.log_class = np.log(np.maximum(grid.sum(1), 1e-9) / grid.sum()).astype(np.float32)
        self.log_member = np.where(self.filled, np.log(np.maximum(grid, 1e-9) / np.maximum(grid.sum(1, keepdims=True), 1e-9)), -1e9).astype(np.float32)
        new = (known.new + 0.5) / (known.rare + 1.0)
        self.log_rest = np.zeros(size)
        self.log_rest[len(top) :] = np.log1p(-new) - np.log(words[len(top) :])
        #: what one new word's log-probability is less than that of a known word of a bucket, words known being alike
        mean_known = np.log(words[len(top) :]).mean()
        self.log_new = float(np.log(new) - np.log(max(1.0, known.new_words / n_buckets)) - (np.log1p(-new) - mean_known))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        bucket = (self.n_words + (h % np.uint64(self.n_buckets)).astype(np.int64)).astype(np.int32)
        if not self.n_words:
            return bucket
        at = np.minimum(np.searchsorted(self.sorted, h), self.n_words - 1)
        return np.where(self.sorted[at] == h, self.rank[at], bucket)


class Network:
    """Weights: embedding, inner, inner bias, class, class bias, member (of each class), member bias."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW, dim: int = DIM, hidden: int = HIDDEN) -> None:
        self.v, self.window, self.dim, rng = vocabulary, window, dim, np.random.Generator(np.random.PCG64(5))
        draw = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        c, m, wide = vocabulary.classes, vocabulary.members, 2 * window * dim
        small = 0.1 * hidden**-0.5
        self.w = [draw(vocabulary.edge + 1, dim, by=0.3), draw(wide, hidden, by=wide**-0.5), np.zeros(hidden, np.float32), draw(hidden, c, by=small), vocabulary.log_class.copy(), draw(c, hidden, m, by=small), np.where(vocabulary.filled, vocabulary.log_member, 0).astype(np.float32)]
        self.absent = np.where(vocabulary.filled, 0, -1e9).astype(np.float32)
        self.sums = [np.full(w.shape, 1e-2, np.float32) for w in self.w]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.w])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, w in enumerate(self.w):
            self.w[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.w[0][context].reshape(len(context), -1)
        return x, np.tanh(x @ self.w[1] + self.w[2])

    def members(self, h: np.ndarray, cls: int) -> np.ndarray:
        """What the softmax of the members of a class is taken of."""
        z = h @ self.w[5][cls]
        z += self.w[6][cls] + self.absent[cls]
        return z

    def log_p(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token, given what is on both sides."""
        h = self.hidden(context)[1]
        cls, slot = self.v.cls[token], self.v.slot[token]
        out = _log_share(h @ self.w[3] + self.w[4], cls)
        for c, rows in _by_class(cls):
            out[rows] += _log_share(self.members(h[rows], c), slot[rows])
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The embedding rows that the mean loss of these tokens depends on, and gradients: of these rows, then of all
        other weights."""
        n = len(token)
        x, h = self.hidden(context)
        cls, slot = self.v.cls[token], self.v.slot[token]
        dz = _loss_gradient(h @ self.w[3] + self.w[4], cls, n)
        dh = dz @ self.w[3].T
        dm, dm0 = np.zeros_like(self.w[5]), np.zeros_like(self.w[6])
        for c, rows in _by_class(cls):
            own = h[rows]
            dy = _loss_gradient(self.members(own, c), slot[rows], n)
            dm[c], dm0[c] = own.T @ dy, dy.sum(0)
            dh[rows] += dy @ self.w[5][c].T
        dh *= 1 - h * h
        dx = (dh @ self.w[1].T).reshape(-1, self.dim)
        flat = context.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.w[0]) <= 1 << 16 else flat, kind="stable")  # a radix sort where it is 16 bits
        of = flat[order]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        return of[first], [np.add.reduceat(dx[order], first, axis=0), x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0), dm, dm0]

    def train(self, context: np.ndarray, token: np.ndarray, size: int = BATCH, rate: float = RATE) -> None:
        """One pass of AdaGrad; its sums last over calls."""
        for i in range(0, len(token), size):
            rows, grads = self.gradients(context[i : i + size], token[i : i + size])
            self.sums[0][rows] += grads[0] ** 2
            self.w[0][rows] -= rate * grads[0] / np.sqrt(self.sums[0][rows])
            for k in range(1, 7):
                self.sums[k] += grads[k] ** 2
                self.w[k] -= rate * grads[k] / np.sqrt(self.sums[k])


#: sums of exponentials between these have neither lost digits nor come near the end of floats of 32 bits
LEAST_SUM, MOST_SUM = 1e-20, 1e30


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - m), its sums by row, and m: 0 where that is safe, which saves passes, or else the most of each row."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e.sum(1)
    if len(z) and total.min() >= LEAST_SUM and total.max() <= MOST_SUM:
        return e, total, 0.0
    most = z.max(1)
    e = np.exp(z - most[:, None])
    return e, e.sum(1), most


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row of z at its place."""
    _, total, most = _exponentials(z)
    return z[np.arange(len(at)), at] - most - np.log(total)


def _loss_gradient(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The gradient for z of the summed -log softmax at each row's place, over n."""
    e, total, _ = _exponentials(z)
    e *= (1 / (total * total.dtype.type(n)))[:, None]
    e[np.arange(len(at)), at] -= 1 / n
    return e


def _by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    of = cls[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(first, [*first[1:], len(of)], strict=True):
        yield int(of[a]), order[a:b]


def _read(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds of documents)."""
    for i, j, buf, offsets in W.chunks(texts):
        low = W.lower(buf)
        starts, ends = W.spans(low, offsets, W.ALNUM)
        yield i, j, W.hashes(low, starts, ends), W.by_document(starts, offsets)


def contexts(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray, window: int, edge: int) -> np.ndarray:
    """Tokens around the places `at`, with the edge token beyond a document's ends."""
    doc = np.searchsorted(bounds, at, "right") - 1
    low, high = bounds[doc], bounds[doc + 1]
    out = np.empty((len(at), 2 * window), np.int32)
    for k, d in enumerate([*range(-window, 0), *range(1, window + 1)]):
        p = at + d
        inside = (p >= low) & (p < high)
        out[:, k] = np.where(inside, tokens[np.clip(p, 0, max(0, len(tokens) - 1))], edge)
    return out


def count_words(rows: DataFrame) -> DataFrame:
    """(hash, n, alone) of every word of rows(key, text): how often it occurs, and the key of the one document that has it,
    null if there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, h, bounds in _read(batch.column(1)):
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                of, by = h[order], np.repeat(keys[i:j], np.diff(bounds))[order]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                made = [of[first].view(np.int64), np.diff(np.append(first, len(of))), np.minimum.reduceat(by, first), np.maximum.reduceat(by, first)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["hash", "n", "low", "high"])

    pairs = rows.mapInArrow(run, "hash long, n long, low long, high long")
    return pairs.groupBy("hash").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).select("hash", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("alone"))


def vocabulary_of(counts: DataFrame, top: int = TOP) -> Vocabulary:
    common = [(r.hash, r.n) for r in counts.orderBy(F.desc("n"), "hash").limit(top).collect()]
    alone = F.col("alone").isNotNull()
    # a bucket is the unsigned hash modulo BUCKETS, a power of two; common words are taken off below
    rest = {r.b: [r.n, r.d, r.new, r.new_words] for r in counts.groupBy(F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("n").alias("n"), F.count(F.when(~alone, 1)).alias("d"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("new"), F.count("alone").alias("new_words")).collect()}
    total = sum(r[0] for r in rest.values())
    by_hash = {h: n for h, n in common}
    for h, n in common:
        rest[h & (BUCKETS - 1)][0] -= n
    # few words are common ones, so whether these are new is asked of them alone
    for r in counts.where(F.col("hash").isin(*by_hash)).collect() if by_hash else []:
        own = rest[r.hash & (BUCKETS - 1)]
        if r.alone is None:
            own[1] -= 1
        else:
            own[2], own[3] = own[2] - r.n, own[3] - 1
    known = Known(total, sum(r[0] for r in rest.values()), sum(r[2] for r in rest.values()), sum(r[3] for r in rest.values()))
    return Vocabulary(common, [(b, n, d) for b, (n, d, _, _) in rest.items()], known)


def tokenised(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows(doc_id, key, text) to doc_id, key, n (words), tokens (unsigned 16 or 32 bits each), new (tokens of no word that
    is common)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        kind = _kind(vocabulary)
        for batch in batches:
            n, out = np.zeros(len(batch), np.int64), []
            for i, j, h, bounds in _read(batch.column(2)):
                tokens = vocabulary.tokens(h).astype(kind)
                out += [tokens[bounds[d] : bounds[d + 1]].tobytes() for d in range(j - i)]
                n[i:j] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(out, pa.binary())], names=["doc_id", "key", "n", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, tokens binary")


def _kind(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.edge < 1 << 16 else "<u4"


def _joined(values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens and the bounds of documents."""
    tokens = np.frombuffer(b"".join(values), kind).astype(np.int32)
    return tokens, np.cumsum([0] + [len(v) // np.dtype(kind).itemsize for v in values])


def _averaged(tokens: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """Weights after every shard of tokens(shard, key, tokens) was trained on from `flat`."""
    shared = tokens.sparkSession.sparkContext.broadcast((vocabulary, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        kind, total, count = _kind(vocabulary), np.zeros(len(flat), np.int64), 0
        net, now, n, held = None, None, 0, []

        def learn() -> None:
            nonlocal held
            of, bounds = _joined(held, kind)
            for a in range(0, len(of), SLICE):
                at = np.arange(a, min(len(of), a + SLICE))
                net.train(contexts(of, bounds, at, net.window, vocabulary.edge), of[at])
            held = []

        def close() -> None:
            nonlocal total, count
            learn()
            total += np.rint(net.flat().astype(np.float64) * UNIT).astype(np.int64) * n
            count += n

        waiting = 0
        for batch in batches:
            for shard, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if net is not None:
                        close()
                    net, now, n, held, waiting = Network(vocabulary).load(flat), shard, 0, [], 0
                held.append(value)
                size = len(value) // np.dtype(kind).itemsize
                n, waiting = n + size, waiting + size
                if waiting >= SLICE:  # where this falls depends on the shard's documents alone
                    learn()
                    waiting = 0
        if net is not None:
            close()
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), count))], names=["i", "w", "n"])

    dealt = tokens.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "tokens")
    mean = dealt.mapInArrow(run, "i int, w long, n long").groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()  # as many rows as weights
    out = flat.astype(np.float64)
    for i, w, n in mean:
        out[i] = int(w) / (UNIT * n)
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray
    tokens: DataFrame
    counts: DataFrame


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = TOP, parts: int = PARTS, shard: int = SHARD) -> Model:
    scratch = Scratch(documents.sparkSession, "masked-lm")
    said = F.col(text).cast("string")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), said).alias("key"), said.alias("text"))
    counts = scratch.table(count_words(rows.select("key", "text")), "counts")
    vocabulary = vocabulary_of(counts, top)
    tokens = scratch.table(tokenised(rows, vocabulary), "tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(1, total // (parts * shard))
    flat = Network(vocabulary).flat()
    dealt = tokens.where("n > 0").withColumns({"part": F.pmod("key", F.lit(parts)), "shard": F.pmod(F.xxhash64("key"), F.lit(shards))})
    for r in range(parts):
        flat = _averaged(dealt.where(F.col("part") == r).select("shard", "key", "tokens"), vocabulary, flat)
    return Model(vocabulary, flat, tokens, counts)


def scored(model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural), mean_log_prob, n_new (words that no other document has)."""
    tokens = model.tokens
    shared = tokens.sparkSession.sparkContext.broadcast((model.vocabulary, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        net = Network(vocabulary).load(flat)
        for batch in batches:
            of, bounds = _joined(batch.column(3).to_pylist(), _kind(vocabulary))
            logs = np.zeros(len(of) + 1)
            for a in range(0, len(of), SLICE):
                at = np.arange(a, min(len(of), a + SLICE))
                own = of[at]
                logs[at] = net.log_p(contexts(of, bounds, at, net.window, vocabulary.edge), own) + vocabulary.log_rest[own]
            total, filled = np.zeros(len(batch)), np.diff(bounds) > 0
            if filled.any():
                total[filled] = np.add.reduceat(logs, bounds[:-1][filled])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], names=["doc_id", "key", "n_tokens", "log_prob"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    made = tokens.mapInArrow(run, f"doc_id {kind}, key long, n_tokens long, log_prob double")
    common = F.col("hash").isin(*(model.vocabulary.sorted.view(np.int64).tolist() or [0]))
    new = model.counts.where("alone IS NOT NULL").groupBy(F.col("alone").alias("key")).agg(F.sum("n").alias("n_new"), F.sum(F.when(~common, F.col("n")).otherwise(0)).alias("n_rest"))
    rows = tokens.where("n > 0").groupBy("key").agg(F.count("*").alias("rows"))  # equal rows have their words together
    new = new.join(rows, "key").select("key", *((F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_new", "n_rest")))
    both = made.join(new, "key", "left")
    log_prob = F.col("log_prob") + F.coalesce("n_rest", F.lit(0)) * model.vocabulary.log_new
    return both.select("doc_id", "n_tokens", log_prob.alias("log_prob"), (log_prob / F.greatest(F.lit(1), F.col("n_tokens"))).alias("mean_log_prob"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def pseudo_likelihood(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    return scored(learn(documents, doc_id, text, **how))
