"""Procedures that CALL reaches: each takes (graph, *args) and returns a DataFrame."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import analytics, indexes, paths, search, traversal
from trellis.plans.graph import Graph


def _labels(g: Graph) -> DataFrame:
    return g.label_view().select("label").distinct()


def _types(g: Graph) -> DataFrame:
    return g.edge_view().select(F.col("p").alias("relationshipType")).distinct()


def _keys(g: Graph) -> DataFrame:
    return g.prop_view().select(F.col("key").alias("propertyKey")).distinct()


def _node_types(g: Graph) -> DataFrame:
    """Keys that have a value on some node of each label."""
    return g.prop_view().join(g.label_view(), "s").select(F.col("label").alias("nodeLabel"), F.col("key").alias("propertyName")).distinct()


def _rel_types(g: Graph) -> DataFrame:
    keys = F.explode(F.json_object_keys("qualifiers"))
    return g.edge_view().select(F.col("p").alias("relType"), keys.alias("propertyName")).distinct()


def _visual(g: Graph) -> DataFrame:
    of = g.label_view()
    return g.edge_view().join(of.toDF("s", "source"), "s").join(of.toDF("o_id", "target"), "o_id").select("source", F.col("p").alias("relationship"), "target").distinct()


def _rows(g: Graph, rows: list[tuple], schema: str) -> DataFrame:
    return g.spark.createDataFrame(rows, schema)


def _neighbors(g: Graph, source: str, predicate: str | None = None, direction: str = "out") -> DataFrame:
    return traversal.neighbors(g.edge_view(), source, predicate, direction).select(F.col("neighbor").alias("node"))


def _ppr(g: Graph, seeds: list[str], options: dict | None = None) -> DataFrame:
    return analytics.personalized_pagerank(g.edge_view(), seeds, **checked(analytics.personalized_pagerank, options)).select(F.col("id").alias("node"), "score")


def _weighted(g: Graph, source: str, target: str, weight: str = "weight", most_cost: float = 9999, hops: int = 10) -> DataFrame:
    got = paths.weighted(g.edge_view(), g.spark.createDataFrame([(source,)], "src string"), most_cost, hops)
    return got.where(F.col("node") == target).select(F.col("nodes").alias("path"), F.col("cost").alias("totalCost"))


#: least and most of numeric options
BOUNDS = {"damping": (0.0, 1.0), "rounds": (1, 10_000), "tolerance": (0.0, 1.0), "hops": (1, 1_000_000), "sample": (1, 1_000_000_000), "gamma": (0.0, 1000.0), "levels": (1, 100), "reverse_weight": (0.0, 1e9)}


def checked(f, options: dict | None) -> dict:
    """The options, if f knows them all and numbers are within bounds; else a ValueError that says which is wrong."""
    options = options or {}
    known = [p for p in inspect.signature(f).parameters if p not in ("edges", "seeds", "sources", "nodes")]
    for k, v in options.items():
        if k not in known:
            raise ValueError(f"option {k!r} is unknown; there are {', '.join(known)}")
        low, high = BOUNDS.get(k, (None, None))
        if low is not None and v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or not low <= v <= high):
            raise ValueError(f"option {k!r} is {v!r}, which is not from {low} to {high}")
    return options


def _vector_search(g: Graph, name: str, query: list[float], k: int = 10, options: dict | None = None) -> DataFrame:
    return indexes.index(g, name).search(query, int(k), **(options or {})).select(F.col("id").cast("string").alias("node"), "score")


def _text_search(g: Graph, name: str, query: str, k: int = 10) -> DataFrame:
    return indexes.index(g, name).search(query, int(k)).select(F.col("id").cast("string").alias("node"), "score")


def _hybrid_search(g: Graph, vectors: str, texts: str, query: list[float], text: str, k: int = 10) -> DataFrame:
    k = int(k)
    found = [indexes.index(g, vectors).search(query, 2 * k), indexes.index(g, texts).search(text, 2 * k)]
    return search.rrf(found, k, depth=2 * k).select(F.col("id").cast("string").alias("node"), "score")


def _stats(g: Graph) -> DataFrame:
    """nodes, edges, labels, types."""
    nodes = g.node_view().agg(F.count("*").alias("nodes"))
    return nodes.crossJoin(g.edge_view().agg(F.count("*").alias("edges"))).select("nodes", "edges", F.lit(len(g.nodes)).alias("labels"), F.lit(len(g.edges)).alias("types"))  # one row each


def _of(f, *cols: str):
    def call(g: Graph, options: dict | None = None) -> DataFrame:
        checked(f, options)
        if "nodes" in inspect.signature(f).parameters:  # nodes without edges count too
            options = {**(options or {}), "nodes": g.node_view().select(F.col("node_id").alias("id"))}
        return f(g.edge_view(), **(options or {})).select(*(F.col(c).alias("node" if c == "id" else c) for c in cols))

    return call


PROCEDURES = {
    "db.labels": _labels, "db.relationshiptypes": _types, "db.propertykeys": _keys, "db.schema.nodetypeproperties": _node_types, "db.schema.reltypeproperties": _rel_types, "db.schema.visualization": _visual,
    "dbms.components": lambda g: _rows(g, [("trellis", "1.0", "community")], "name string, versions string, edition string"),
    "dbms.procedures": lambda g: _rows(g, [(n,) for n in sorted({*PROCEDURES, *g.procedures})], "name string"),
    "dbms.functions": lambda g: _rows(g, [(n,) for n in _function_names()], "name string"),
    "dbms.showcurrentuser": lambda g: _rows(g, [("spark",)], "username string"), "dbms.clientconfig": lambda g: _rows(g, [], "name string, value string"), "dbms.queryjmx": lambda g: _rows(g, [], "name string, attributes string"),
    "apoc.meta.data": _node_types, "apoc.meta.schema": _visual,
    "graph.stats": _stats, "search.vector": _vector_search, "search.fulltext": _text_search, "search.hybrid": _hybrid_search, "db.index.vector.querynodes": lambda g, name, k, query: _vector_search(g, name, query, k),
    "db.index.fulltext.querynodes": _text_search, "graph.mappings": lambda g: _rows(g, g.mappings(), "kind string, name string"), "graph.indexes": lambda g: _rows(g, [(n, i.kind) for n, i in sorted(g.indexes.items())], "name string, kind string"),
    "graph.neighbors": _neighbors, "graph.ppr": _ppr, "graph.shortestpath.weighted": _weighted,
    "graph.pagerank": _of(analytics.pagerank, "id", "score"), "graph.wcc": _of(analytics.components, "id", "component"), "graph.cdlp": _of(analytics.label_propagation, "id", "label"),
    "graph.degreecentrality": _of(analytics.degree_centrality, "id", "score", "degree"), "graph.closeness": _of(analytics.closeness, "id", "score"), "graph.eigenvector": _of(analytics.eigenvector, "id", "score"), "graph.betweenness": _of(analytics.betweenness, "id", "score"),
    "graph.trianglecount": _of(analytics.triangles, "id", "triangles", "lcc"), "graph.scc": _of(analytics.strong_components, "id", "component"), "graph.kcore": _of(analytics.k_core, "id", "coreness"), "graph.leiden": _of(analytics.communities, "id", "community"),
}
#: names that other graph tools use for the same
for _shim, _own in (("pagerank", "pagerank"), ("wcc", "wcc"), ("labelpropagation", "cdlp"), ("degree", "degreecentrality"), ("closeness", "closeness"), ("eigenvector", "eigenvector"), ("betweenness", "betweenness"), ("trianglecount", "trianglecount"), ("scc", "scc"), ("louvain", "leiden"), ("leiden", "leiden"), ("kcore", "kcore")):
    PROCEDURES[f"gds.{_shim}.stream"] = PROCEDURES[f"graph.{_own}"]


def _function_names() -> list[str]:
    from trellis.functions.scalar import AGGREGATES, SCALAR

    return sorted({*SCALAR, *AGGREGATES})
