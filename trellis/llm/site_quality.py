"""Quality by hierarchical empirical Bayes: evidence of the document, shrunken to its path, host and the whole.

1. A logistic regression on shares of hashed words and on shape (length, symbols, capitals, digits, distinct words) is
   fitted to at most `sample` labelled documents of least hash; it gives each document its log-odds.
2. Documents are grouped by (host, path) and host; a labelled document counts as its label, another as its probability.
   A site's rate is shrunk to that of the level above: (K + m * rate above) / (N + m), where m comes from the spread of
   rates at that level beyond what binomial noise explains (method of moments). A document is left out of its own site.
3. Its posterior log-odds are the classifier's, less those of the training sample, plus those of its site.

Sums are partial before any shuffle, so a host with a third of all rows is no task's burden. Documents have no URL, so
host is the `source` and path the `lang` column by default. Nulls in either are a site of their own. A null text has no
words and the evidence of a text of length 0. Without usable labels the evidence is 0. Labels of one document that
disagree are averaged; null labels and ids are ignored. Rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import words as W
from trellis.storage import Scratch

SAMPLE, BUCKETS = 4000, 256
SHAPE = 6
_MARKS = [np.isin(np.arange(256), [*map(ord, x)]) for x in ("#*$%&|<>!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")]


def features(texts: pa.Array) -> np.ndarray:
    """One row of BUCKETS word shares and SHAPE numbers for each text."""
    out = np.zeros((len(texts), BUCKETS + SHAPE), np.float32)
    for i, j, buf, offsets in W.chunks(texts):
        low = W.lower(buf)
        starts, ends = W.spans(low, offsets, W.NONSPACE)
        bounds = W.by_document(starts, offsets)
        h, n = W.hashes(low, starts, ends), np.diff(bounds)
        doc = np.repeat(np.arange(j - i), n)
        each, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
        bags = np.bincount(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS)
        out[i:j, :BUCKETS] = bags / each[:, None]
        shares = [np.diff(np.concatenate([[0], np.cumsum(m[buf])])[offsets]) for m in _MARKS]
        own = h ^ W.mix(doc.astype(np.uint64))  # a number for each word of each document
        lead = np.argsort(own)
        fresh = np.r_[True, own[lead][1:] != own[lead][:-1]][: len(own)]
        distinct = np.bincount(doc[lead], fresh, j - i)
        out[i:j, BUCKETS:] = np.stack([np.minimum(3, shares[0] / each), shares[1] / size, shares[2] / size, distinct / each, np.log1p(n) / 10, size / each / 20], axis=1)
    return out


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton's method on standardised columns."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def site_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """doc_id, evidence (log-odds), host_rate, path_rate, p_quality, kept (p_quality >= 0.5)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "site-quality")
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(batch.column(0))], pa.binary()), batch.column(1)], names=["x", "y"])

    rows = own.join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(described, "x binary, y double").limit(4 * sample).collect()
    y = np.array([r.y >= 0.5 for r in rows], float)
    weights, shift, base = np.zeros(BUCKETS + SHAPE), 0.0, 0.5
    if 0 < y.sum() < len(y):
        weights, shift = fitted(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), y)
        base = float(y.mean())
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shift = shared.value
        for batch in batches:
            for i, j, _, _ in W.chunks(batch.column(3)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array((features(part.column(3)) @ weights + shift).astype(np.float64))], names=["doc_id", "host", "path", "evidence"])

    kind = documents.schema[doc_id].dataType.simpleString()
    scored = own.mapInArrow(run, f"doc_id {kind}, host string, path string, evidence double").join(known, "doc_id", "left")
    scored = scratch.table(scored.withColumn("v", F.coalesce("y", 1 / (1 + F.exp(-F.col("evidence"))))).drop("y"), "scored")

    paths = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("v").alias("k")), "paths")
    hosts = scratch.table(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k")), "hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_k").alias("k")).first()
    top = (whole.k or 0.0) / whole.n if whole.n else base

    def strength(df: DataFrame, k: str, n: str, above: Column) -> float:
        """m of a Beta prior whose variance is that of site rates about `above` less the binomial part."""
        got = df.where(F.col(n) > 1).agg(F.avg((F.col(k) / F.col(n) - above) ** 2 - above * (1 - above) / F.col(n)).alias("v"), F.avg(above * (1 - above)).alias("b")).first()
        if got.v is None or got.v <= 1e-9:
            return 1e4
        return float(min(1e4, max(1.0, got.b / got.v - 1)))

    m_host = strength(hosts, "host_k", "host_n", F.lit(top))
    inside = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"], "path", "n", "k", "host_n", "host_k")
    m_path = strength(inside, "k", "n", (F.col("host_k") + m_host * top) / (F.col("host_n") + m_host))
    sites = scratch.table(inside.withColumnsRenamed({"host": "site_host", "path": "site_path"}), "sites")
    met = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    host_rate = (F.col("host_k") - F.col("v") + m_host * top) / (F.col("host_n") - 1 + m_host)
    path_rate = (F.col("k") - F.col("v") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path)
    p = 1 / (1 + F.exp(-(F.col("evidence") - float(np.log(base / (1 - base))) + _logit(F.col("path_rate")))))
    out = met.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("p_quality", p)
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "p_quality", (F.col("p_quality") >= 0.5).alias("kept"))
