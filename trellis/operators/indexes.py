"""Approximate vector indexes, and one facade over all kinds of index.

Every index holds all rows; a search looks at a part of them and ranks that part exactly, with `exact` for the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators import search, traversal
from trellis.storage import Scratch


class ProjectionForest:
    """Trees of random hyperplanes: a leaf is the signs of `depth` projections, taken around the median of a bounded
    sample. A search visits, in every tree, its own leaf and those whose planes it lies nearest to."""

    def __init__(self, vectors: DataFrame, trees: int = 8, depth: int = 5, sample: int = 10_000, seed: int = 42, id_column: str = "id", vector: str = "embedding") -> None:
        rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_column, F.lit(seed)), id_column).limit(sample).select(vector).collect()
        self.seed, self.depth, self.source = seed, depth, vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("embedding"))
        x = np.array([r[0] for r in rows], float).reshape(len(rows), -1)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.planes = rng.standard_normal((trees, depth, x.shape[1]))
        self.cut = np.median(np.einsum("nd,tkd->ntk", x, self.planes), axis=0) if len(x) else np.zeros((trees, depth))
        leaves = [F.concat_ws("", F.lit(f"{t}:"), *(F.when(_dot(F.col("embedding"), self.planes[t, j]) > float(self.cut[t, j]), "1").otherwise("0") for j in range(depth))) for t in range(trees)]
        made = self.source.where("embedding IS NOT NULL").select("id", "embedding", F.explode(F.array(*leaves)).alias("leaf"))
        self.table = Scratch(vectors.sparkSession, "forest").table(made, "leaves")

    def leaves(self, query, probe: int) -> list[str]:
        side = np.einsum("d,tkd->tk", np.array(list(query), float), self.planes) - self.cut
        out = []
        for t, row in enumerate(side):
            own = (row > 0).astype(int)
            # flips of one plane or two, in order of how near the planes are that are crossed
            flips = sorted([((), 0.0), *(((i,), abs(row[i])) for i in range(len(row))), *(((i, j), abs(row[i]) + abs(row[j])) for i in range(len(row)) for j in range(i))], key=lambda f: f[1])[:probe]
            for flip, _ in flips:
                bits = own.copy()
                bits[list(flip)] ^= 1
                out.append(f"{t}:" + "".join(map(str, bits)))
        return out

    def search(self, query, k: int = 10, probe: int = 6, by: str = "cosine", exact: bool = False) -> DataFrame:
        """id, score. `exact` scans all rows instead."""
        if exact:
            return search.knn(self.source, query, k, by)
        near = self.table.where(F.col("leaf").isin(*self.leaves(query, probe))).dropDuplicates(["id"])
        return search.knn(near, query, k, by)


def _dot(v: Column, w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, p: s + p)


def cells_within_reach(cells: search.IVF, edges: DataFrame, seed: str, hops: int, query, k: int = 10, probe: int = 4, direction: str = "out") -> DataFrame:
    """id, score: what a seed reaches within `hops`, kept to the query's nearest cells, then ranked exactly."""
    near = ((cells.centres - list(query)) ** 2).sum(1).argsort()[:probe].tolist()
    met = traversal.reach(edges, edges.sparkSession.createDataFrame([(seed,)], "src string"), 1, hops, direction).select(F.col("node").alias("id")).distinct()
    return search.knn(cells.table.where(F.col("cell").isin(*near)).withColumn("id", F.col("id").cast("string")).join(met, "id", "left_semi"), query, k)


class IndexError_(ValueError):
    """An index that is not there, is there already, or has no rows."""


class Index:
    """kind: vector (forest), ivf, exact, fulltext (BM25) or multivector (late interaction)."""

    KINDS = ("vector", "ivf", "exact", "fulltext", "multivector")

    def __init__(self, name: str, kind: str, df: DataFrame, **options) -> None:
        if kind not in self.KINDS:
            raise IndexError_(f"{kind!r} is none of {', '.join(self.KINDS)}")
        self.name, self.kind, self.df, self.options = name, kind, df, options
        self.built = None

    def build(self) -> Index:
        if self.df.isEmpty():
            raise IndexError_(f"index {self.name!r} has no rows")
        make = {"vector": lambda: ProjectionForest(self.df, **self.options), "ivf": lambda: search.IVF(self.df, **self.options), "fulltext": lambda: search.BM25(self.df, **self.options)}
        self.built = make.get(self.kind, lambda: self.df)()
        return self

    def insert(self, rows: DataFrame) -> Index:
        """More rows; those of the same id give way. The index is built anew at the next search."""
        ident = self.options.get("id_column", "id")
        self.df, self.built = self.df.join(rows.select(ident), ident, "left_anti").unionByName(rows), None
        return self

    def search(self, query, k: int = 10, **how) -> DataFrame:
        if self.built is None:
            self.build()
        if self.kind == "exact":
            return search.knn(self.df, query, k, **{**self.options, **how})
        if self.kind == "multivector":
            return search.maxsim(self.df, query, k)
        return self.built.search(query, k, **how)

    def info(self) -> dict:
        return {"name": self.name, "kind": self.kind, "rows": self.df.count(), "built": self.built is not None, **self.options}


def create_index(graph, name: str, kind: str, df: DataFrame, **options) -> Index:
    if name in graph.indexes:
        raise IndexError_(f"index {name!r} is there already")
    graph.indexes[name] = Index(name, kind, df, **options)
    return graph.indexes[name]


def index(graph, name: str) -> Index:
    if name not in graph.indexes:
        raise IndexError_(f"there is no index {name!r}")
    return graph.indexes[name]


def drop_index(graph, name: str) -> None:
    index(graph, name)
    del graph.indexes[name]
