"""Vector, text, late-interaction and fused search.

Vectors are arrays; scores are exact. Rankings are cut to k by `orderBy.limit` before ranks are numbered, so no more than
k rows ever meet in one partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.scalar import cosine, dot
from trellis.storage import Scratch


def _vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def metric(name: str, a: Column, b: Column) -> Column:
    """Higher is closer: cosine, dot, or 1 / (1 + distance) for l2, l1, chebyshev."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    zero = F.lit(0.0)
    if name == "cosine":
        return cosine(a, b)
    if name in ("dot", "dot_product"):
        return dot(a, b)
    far = {
        "l2": lambda: F.sqrt(F.aggregate(gap, zero, lambda s, v: s + v * v)), "l1": lambda: F.aggregate(gap, zero, lambda s, v: s + v), "chebyshev": lambda: F.aggregate(gap, zero, lambda s, v: F.greatest(s, v)),
    }[name]()
    return 1 / (1 + far)


def knn(vectors: DataFrame, query, k: int = 10, by: str = "cosine", threshold: float | None = None, exclude=None, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """id, score of the k nearest; ties to the lesser id."""
    df = vectors if exclude is None else vectors.where(F.col(id_column) != exclude)
    out = df.select(F.col(id_column).alias("id"), metric(by, F.col(vector), _vector(query)).alias("score")).where(F.col("score").isNotNull())
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "id").limit(k)


def vector_of(vectors: DataFrame, ident, id_column: str = "id", vector: str = "embedding") -> list[float]:
    return list(vectors.where(F.col(id_column) == ident).select(vector).first()[0])


def knn_by_id(vectors: DataFrame, ident, k: int = 10, **how) -> DataFrame:
    """The query is a row's own vector; the row itself is left out."""
    names = {x: how[x] for x in ("id_column", "vector") if x in how}
    return knn(vectors, vector_of(vectors, ident, **names), k, exclude=ident, **how)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """id, score, rank of the k best, from 1."""
    return hits.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], k: int = 10, c: int = 60, depth: int = 100, weights: list[float] | None = None) -> DataFrame:
    """id, score: sum of weight / (c + rank) over the lists that have the id."""
    w = weights or [1.0] * len(lists)
    parts = [ranked(x, depth).select("id", (F.lit(float(v)) / (c + F.col("rank"))).alias("part")) for x, v in zip(lists, w, strict=True)]
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def rrf_outer(a: DataFrame, b: DataFrame, k: int = 10, ka: int = 50, kb: int = 50, c: int = 60, missing: int = 1_000_000_000) -> DataFrame:
    """id, score, va, vb: a full outer join of two rankings; a missing rank counts as a very large one."""
    x, y = ranked(a, ka).select("id", F.col("rank").alias("ra"), F.col("score").alias("va")), ranked(b, kb).select("id", F.col("rank").alias("rb"), F.col("score").alias("vb"))
    score = 1 / (c + F.coalesce("ra", F.lit(missing))) + 1 / (c + F.coalesce("rb", F.lit(missing)))
    return x.join(y, "id", "full").select("id", score.alias("score"), "va", "vb").orderBy(F.desc("score"), "id").limit(k)


def weighted_fusion(lists: list[DataFrame], weights: list[float], k: int = 10) -> DataFrame:
    """id, score: scores times weights that add up to one; a missing list gives 0."""
    total = sum(weights) or 1.0
    parts = [x.select("id", (F.col("score") * (w / total)).alias("part")) for x, w in zip(lists, weights, strict=True)]
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda t: t != "")


class BM25:
    """Postings with document lengths; built once, searched often. Documents without a token are not indexed."""

    def __init__(self, documents: DataFrame, id_column: str = "id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> None:
        self.k1, self.b, scratch = k1, b, Scratch(documents.sparkSession, "bm25")
        said = documents.where(F.lower(F.col(text)).rlike("[a-z0-9]"))  # so that tokens are found once, not for a test as well
        words = said.select(F.col(id_column).alias("id"), F.sort_array(tokens(F.col(text))).alias("t")).select("id", F.size("t").alias("len"), "t")
        if documents.groupBy(F.col(id_column)).count().where("count > 1").isEmpty():
            # a document is one row: its sorted tokens are counted in place, from where each begins, and nothing is shuffled
            begins = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
            cut = words.select("id", "len", "t", F.concat(begins, F.array(F.size("t") + 1)).alias("cut"))
            each = F.transform(F.sequence(F.lit(1), F.size("cut") - 1), lambda i: F.struct(F.get("t", F.get("cut", i - 1) - 1).alias("term"), (F.get("cut", i) - F.get("cut", i - 1)).cast("long").alias("tf"), (i == 1).alias("first")))
            self.postings = scratch.table(cut.select("id", "len", F.inline(each)), "postings")
            sizes = self.postings.where("first").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        else:
            counted = words.select("id", "len", F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
            self.postings = scratch.table(counted, "postings")
            sizes = self.postings.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        self.n, self.mean = sizes.n, sizes.mean or 1.0

    def scored(self, query: str) -> DataFrame:
        """id, score of every document with a term of the query; a repeated term counts again."""
        spark = self.postings.sparkSession
        asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
        met = self.postings.join(F.broadcast(asked), "term")  # the terms of one query
        df = met.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.col("times") * idf * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("len") / self.mean))
        return met.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        return self.scored(query).orderBy(F.desc("score"), "id").limit(k)


def text_like(documents: DataFrame, query: str, k: int = 10, fields: tuple[str, ...] = ("text",), scores: tuple[float, ...] = (1.0, 0.8, 0.5), id_column: str = "id") -> DataFrame:
    """id, score by the first field that has the query; ties to the shorter field, then the lesser id."""
    has = [F.upper(F.col(f)).contains(query.upper()) for f in fields]
    score = reduce(lambda a, i: F.when(has[i], scores[min(i, len(scores) - 1)]).otherwise(a), range(len(fields) - 1, -1, -1), F.lit(0.0))
    size = reduce(lambda a, i: F.when(has[i], F.length(fields[i])).otherwise(a), range(len(fields) - 1, -1, -1), F.lit(0))
    return documents.select(F.col(id_column).alias("id"), score.alias("score"), size.alias("_size")).where("score > 0").orderBy(F.desc("score"), "_size", "id").limit(k).drop("_size")


def text_edges(edges: DataFrame, query: str, k: int = 10, least: int = 0) -> DataFrame:
    """id, score of edges' sources: confidence / 1000, plus 0.5 where the target has the query."""
    conf = F.coalesce(F.get_json_object("qualifiers", "$.confidence").cast("double"), F.lit(0.0))
    has = F.lower("o_id").contains(query.lower())
    hits = edges.where((conf >= least) | has).select(F.col("s").alias("id"), (conf / 1000 + F.when(has, 0.5).otherwise(0.0)).alias("score"))
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def maxsim(tokens_of: DataFrame, query: list[list[float]], k: int = 10) -> DataFrame:
    """id, score of multi-vector documents(id, token): for each query vector the best dot product, summed."""
    best = [F.max(dot(F.col("token"), _vector(q))).alias(f"_q{i}") for i, q in enumerate(query)]
    out = tokens_of.groupBy("id").agg(*best)
    return out.select("id", reduce(lambda a, b: a + b, (F.col(f"_q{i}") for i in range(len(query)))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


class IVF:
    """Cells of a k-means on a bounded sample; a search ranks exactly inside the `probe` nearest cells."""

    def __init__(self, vectors: DataFrame, cells: int = 16, sample: int = 10_000, rounds: int = 10, seed: int = 42, id_column: str = "id", vector: str = "embedding") -> None:
        import numpy as np

        rows = vectors.orderBy(F.xxhash64(id_column, F.lit(seed))).limit(sample).select(vector).collect()
        x = np.array([r[0] for r in rows], float).reshape(len(rows), -1)
        centre = x[: min(cells, len(x))].copy()
        for _ in range(rounds):
            near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for i in range(len(centre)):
                if (near == i).any():
                    centre[i] = x[near == i].mean(0)
        self.centres = centre
        far = [F.aggregate(F.zip_with(F.col(vector), _vector(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centre]
        cell = F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1
        self.table = Scratch(vectors.sparkSession, "ivf").table(vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("embedding"), cell.cast("int").alias("cell")), "cells")

    def search(self, query, k: int = 10, probe: int = 4, by: str = "cosine") -> DataFrame:
        near = ((self.centres - list(query)) ** 2).sum(1).argsort()[:probe].tolist()
        return knn(self.table.where(F.col("cell").isin(*near)), query, k, by)


def hybrid(vectors: DataFrame, query, index: BM25, text: str, k: int = 10, c: int = 60) -> DataFrame:
    """Nearest vectors and BM25, each to depth 2k, fused by reciprocal ranks."""
    return rrf([knn(vectors, query, 2 * k), index.search(text, 2 * k)], k, c, 2 * k)


def rerank_by_vector(nodes: DataFrame, vectors: DataFrame, query, k: int = 10) -> DataFrame:
    """The vectors of a set of nodes(id), such as a neighbourhood, by cosine."""
    return knn(vectors.join(nodes.select("id").distinct(), "id", "left_semi"), query, k)


def multi_vector(sources: list[tuple[DataFrame, float]], query, k: int = 10, c: int = 60) -> DataFrame:
    """Several vector tables, each to depth 2k, fused."""
    return rrf([knn(v, query, 2 * k) for v, _ in sources], k, c, 2 * k, [w for _, w in sources])


def edge_knn(edges: DataFrame, query, k: int = 10, threshold: float | None = None) -> DataFrame:
    """s, p, o_id, score of the nearest edge embeddings; edges(s, p, o_id, embedding)."""
    out = edges.select("s", "p", "o_id", cosine(F.col("embedding"), _vector(query)).alias("score")).where("score IS NOT NULL")
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "s", "p", "o_id").limit(k)


def edge_knn_by(edges: DataFrame, vectors: DataFrame, query, k: int = 10) -> DataFrame:
    """edge_knn of edges(s, p, o_id, id) that take the vector of an id: a score for each vector, not for each edge."""
    near = vectors.select("id", cosine(F.col("embedding"), _vector(query)).alias("score")).where("score IS NOT NULL")
    return edges.join(F.broadcast(near) if near.count() <= 100_000 else near, "id").select("s", "p", "o_id", "score").orderBy(F.desc("score"), "s", "p", "o_id").limit(k)


#: properties that name an entity, best first
NAMES = ("name", "title", "label", "description")


def search_documents(nodes: DataFrame, query: str, k: int = 10, label: str | None = None, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """id, score of nodes(node_id, labels, props) whose naming properties have the query."""
    df = nodes if label is None else nodes.where(F.array_contains("labels", label))
    return text_like(df.select(F.col("node_id").alias("id"), *(F.col("props")[f].alias(f) for f in fields)), query, k, fields)


def entity_names(nodes: DataFrame, ids: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """id, name: the first naming property that a node has, else its id."""
    found = nodes.select(F.col("node_id").alias("id"), F.coalesce(*(F.col("props")[f] for f in fields)).alias("name"))
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("name", "id").alias("name"))


def search_with_context(nodes: DataFrame, edges: DataFrame, query: str, k: int = 10, **how) -> DataFrame:
    """id, score, neighbors: hits with the targets of their edges, in order."""
    hits = search_documents(nodes, query, k, **how)
    near = edges.join(F.broadcast(hits.select(F.col("id").alias("s"))), "s").groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("o_id")).alias("neighbors"))
    return hits.join(near, "id", "left").select("id", "score", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))


def multi_modal(vectors: DataFrame, query, text_hits: DataFrame, edges: DataFrame, k: int = 10, method: str = "rrf", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), confidence: int = 600, top: int = 5) -> DataFrame:
    """id, score: vectors (3k, at most 100), text, and what the `top` of both lead to by edges of that confidence, fused
    by ranks or by weights. Ids are strings."""
    near = knn(vectors.withColumn("id", F.col("id").cast("string")), query, min(3 * k, 100))
    said = ranked(text_hits.withColumn("id", F.col("id").cast("string")), min(3 * k, 100)).select("id", "score")
    heads = rrf([near, said], top)
    conf = F.coalesce(F.get_json_object("qualifiers", "$.confidence").cast("double"), F.lit(1000.0))
    led = edges.where(conf >= confidence).join(F.broadcast(heads.select(F.col("id").alias("s"), F.col("score").alias("from"))), "s")
    led = led.groupBy(F.col("o_id").alias("id")).agg(F.max(F.col("from") * conf / 1000).alias("score"))
    if method == "rrf":
        return rrf([near, said, led], k, weights=list(weights))
    return weighted_fusion([near, said, led], list(weights), k)


def adaptive(vectors: DataFrame, query, text_hits: DataFrame | None, edges: DataFrame, k: int = 10) -> DataFrame:
    """Vectors alone where there is no text; else by ranks, text weighing more where it finds fewer than k."""
    if query is None and text_hits is None:
        raise ValueError("a vector or a text is needed")
    if text_hits is None:
        return knn(vectors.withColumn("id", F.col("id").cast("string")), query, k)
    if query is None:
        return ranked(text_hits, k).select(F.col("id").cast("string").alias("id"), "score")
    few = text_hits.limit(k).count() < k
    return multi_modal(vectors, query, text_hits, edges, k, weights=(1.0, 2.0 if few else 1.0, 0.5))


def vector_graph(vectors: DataFrame, query, edges: DataFrame, k: int = 10, hops: int = 1) -> DataFrame:
    """id, score: the nearest vectors and what they lead to, by vector similarity alone."""
    from trellis.operators.traversal import reach

    own = vectors.withColumn("id", F.col("id").cast("string"))
    near = knn(own, query, k)
    met = reach(edges, near.select(F.col("id").alias("src")), 0, hops).select(F.col("node").alias("id"))
    return knn(own.join(met.distinct(), "id", "left_semi"), query, k)


def rerank(vectors: DataFrame, query, text_hits: DataFrame, n: int = 10) -> DataFrame:
    """Both rankings to depth 2n, fused by ranks."""
    return rrf([knn(vectors, query, 2 * n), text_hits], n, depth=2 * n)
