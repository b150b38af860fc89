"""Traversal, analytics, search, temporal and write operators over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import analytics as A
from trellis.operators import inference, mutate, paths, search, temporal, traversal
from trellis.plans.graph import Graph
from trellis.sources import formats
from trellis.sources.tables import chain_graph, graph, supply_graph, temporal_edges
from trellis.storage import Scratch, read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: edges of parts and suppliers, and of events, as common table expressions
SUPPLY = "e AS (SELECT DISTINCT 'Part:' || l_partkey AS s, 'Supplier:' || l_suppkey AS o FROM lineitem), n AS (SELECT s AS id FROM e UNION SELECT o FROM e), b AS (SELECT s AS u, o AS v FROM e UNION SELECT o, s FROM e)"
EVENTS = "t AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'user:' || user_id AS s, event_type AS p, 'k:' || (props ->> '$.k') AS o, value AS w FROM events)"
EDGES = "g AS (SELECT 'Nation:' || n_nationkey AS s, 'IN_REGION' AS p, 'Region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'IN_NATION', 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'BASED_IN', 'Nation:' || s_nationkey FROM supplier)"
START, END, NOW = 1_704_067_200, 1_704_153_600, 1_704_153_600


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _places(g: Graph) -> DataFrame:
    return g.edge_view(["IN_REGION", "IN_NATION", "BASED_IN"])


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "src string")


# --- traversal
@query("SELECT 'Nation:' || c_nationkey AS id, 1 AS dist FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'Region:' || n_regionkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def khop_dist(spark, d):
    return traversal.khop(_places(graph(spark, d)), "Customer:5", 3)


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey = 3")
def one_hop_count(spark, d):
    return traversal.neighbors(_places(graph(spark, d)), "Nation:3", "IN_NATION", "in").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT a.s, count(*) AS paths, CAST(count(DISTINCT b.o) AS BIGINT) AS nodes FROM (SELECT DISTINCT s, o FROM g) a JOIN (SELECT DISTINCT s, o FROM g) b ON a.o = b.s GROUP BY 1")
def two_hop_exact(spark, d):
    return traversal.two_hop(_places(graph(spark, d)))


@query(f"WITH {EDGES} SELECT s, p, count(DISTINCT o) AS degree FROM g GROUP BY 1, 2")
def degree_stats(spark, d):
    return traversal.degrees(_places(graph(spark, d)))


@query("SELECT 'Region:' || n_regionkey AS neighbor FROM nation WHERE n_nationkey = 3 UNION SELECT 'Customer:' || c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT 'Supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3")
def neighbors_both(spark, d):
    return traversal.neighbors(_places(graph(spark, d)), "Nation:3", None, "both")


@query("WITH x AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5) SELECT 1 AS path_id, 1 AS step, 'Customer:5' AS s, 'IN_NATION' AS p, 'Nation:' || k AS o FROM x UNION ALL SELECT 1, 2, 'Nation:' || k, 'IN_REGION', 'Region:' || r FROM x")
def meta_path(spark, d):
    return traversal.meta_path(_places(graph(spark, d)), "Customer:5", "IN_NATION", "IN_REGION")


@query("SELECT 'Part:' || l_partkey AS s, 'SUPPLIED_BY' AS p, 'Supplier:' || l_suppkey AS o_id, CAST(floor(1000 * (1 - max(l_discount))) AS INTEGER) AS confidence FROM lineitem WHERE l_partkey IN (1, 2, 3) GROUP BY l_partkey, l_suppkey HAVING floor(1000 * (1 - max(l_discount))) >= 950")
def neighborhood_expansion(spark, d):
    return traversal.neighborhood_expansion(graph(spark, d).edge_view(["SUPPLIED_BY"]), ["Part:1", "Part:2", "Part:3"], 950)


@query(f"WITH {EDGES}, h AS (SELECT s, p, o, 1 AS step FROM g WHERE s IN ('Customer:1', 'Supplier:1')) SELECT s, p, o, CAST(1.0 AS DOUBLE) AS w, step FROM h UNION ALL SELECT DISTINCT g.s, g.p, g.o, 1.0, 2 FROM g JOIN h ON g.s = h.o")
def graph_walk(spark, d):
    return traversal.bfs_edges(_places(graph(spark, d)), _seed(spark, "Customer:1", "Supplier:1"), 3)


@query(f"WITH {EDGES}, h AS (SELECT o FROM g WHERE s = 'Customer:1' AND p = 'IN_NATION') SELECT g.s, g.p, g.o, CAST(1.0 AS DOUBLE) AS w, 2 AS step FROM g JOIN h ON g.s = h.o WHERE p = 'IN_REGION' UNION ALL SELECT s, p, o, 1.0, 1 FROM g WHERE s = 'Customer:1' AND p = 'IN_NATION'")
def bfs_positional(spark, d):
    return traversal.bfs_edges(_places(graph(spark, d)), _seed(spark, "Customer:1"), 2, ["IN_NATION", "IN_REGION"])


@query(f"WITH {EDGES}, k AS (SELECT o AS id FROM g WHERE s = 'Customer:1'), r AS (SELECT 'Customer:1' AS id UNION SELECT id FROM k UNION SELECT g.o FROM g JOIN k ON g.s = k.id) SELECT s, p, o AS o_id, CAST(1.0 AS DOUBLE) AS weight FROM g WHERE s IN (SELECT id FROM r) AND o IN (SELECT id FROM r)")
def subgraph(spark, d):
    return traversal.subgraph(_places(graph(spark, d)), _seed(spark, "Customer:1"), 2)


@query("SELECT 'Nation:' || n_nationkey AS s FROM nation")
def structural_guard(spark, d):
    return traversal.structural_guard(_places(graph(spark, d)), ["IN_REGION"])


@query()
def random_walk(spark, d):
    return traversal.random_walks(_places(graph(spark, d)), _seed(spark, "Customer:1", "Customer:2"), 4, 3)


@query("SELECT 'Customer:' || c_custkey AS src, 'Region:' || n_regionkey AS dst, ['Customer:' || c_custkey, 'Nation:' || n_nationkey, 'Region:' || n_regionkey] AS nodes, ['IN_NATION', 'IN_REGION'] AS rels, 2 AS length FROM customer JOIN nation ON c_nationkey = n_nationkey")
def shortest_path(spark, d):
    ids = lambda label, name, key: read_table(spark, d, name).select(F.concat(F.lit(f"{label}:"), key))
    pairs = ids("Customer", "customer", "c_custkey").toDF("src").crossJoin(ids("Region", "region", "r_regionkey").toDF("dst"))
    return paths.shortest(_places(graph(spark, d)), pairs, 4)


@query(f"WITH {SUPPLY} SELECT 'Part:1' AS src, 'Part:2' AS dst, ['Part:1', a.v, 'Part:2'] AS nodes, ['SUPPLIED_BY', 'SUPPLIED_BY'] AS rels, 2 AS length FROM b a JOIN b c ON a.v = c.u WHERE a.u = 'Part:1' AND c.v = 'Part:2'")
def all_shortest_paths(spark, d):
    return paths.shortest(supply_graph(spark, d), spark.createDataFrame([("Part:1", "Part:2")], "src string, dst string"), 2, "both", every=True)


@query(f"WITH {SUPPLY}, q AS (SELECT a.u AS p0, a.v AS p1, c.v AS p2, x.v AS p3 FROM b a JOIN b c ON a.v = c.u JOIN b x ON c.v = x.u WHERE a.u = 'Part:1' AND c.v <> a.u AND x.v <> a.v) SELECT p0 AS src, p3 AS dst, [p0, p1, p2, p3] AS nodes, 3 AS length FROM q WHERE p3 = 'Supplier:5' UNION ALL SELECT u, v, [u, v], 1 FROM b WHERE u = 'Part:1' AND v = 'Supplier:5'")
def all_simple_paths(spark, d):
    return paths.simple(supply_graph(spark, d), spark.createDataFrame([("Part:1", "Supplier:5")], "src string, dst string"), 1, 3, "both")


@query("WITH w AS (SELECT o_orderkey AS o, l_partkey AS p, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY 1, 2), z AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), c AS (SELECT 'Order:' || o AS node, 1.0 AS cost FROM w UNION ALL SELECT 'Part:' || p, 1 + q FROM w UNION ALL SELECT 'Supplier:' || s, 1 + w.q + z.q FROM w JOIN z ON w.p = z.p UNION ALL SELECT 'Customer:7', 0) SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM c GROUP BY 1")
def weighted_path(spark, d):
    return paths.weighted(graph(spark, d).edge_view(["PLACED", "CONTAINS", "SUPPLIED_BY"]), _seed(spark, "Customer:7")).select("node", "cost")


@query("SELECT 'Turn:' || conv_id || ':0' AS src, max(turn) AS hops FROM conversations GROUP BY conv_id HAVING max(turn) > 0")
def long_paths(spark, d):
    seeds = read_table(spark, d, "conversations").select(F.concat(F.lit("Turn:"), "conv_id", F.lit(":0")).alias("src")).distinct()
    return traversal.reach(chain_graph(spark, d).edges["NEXT"].df, seeds, 1, 1_000_000).groupBy("src").agg(F.max("hop").cast("long").alias("hops"))


# --- analytics
def _rounds(n: int, first: str, step: str) -> str:
    return ", ".join([first.format(i=0)] + [step.format(i=i, j=i - 1) for i in range(1, n + 1)])


@query(f"WITH {EDGES}, z AS (SELECT s AS id FROM g UNION SELECT o FROM g), q AS (SELECT s AS id FROM g UNION ALL SELECT o FROM g) SELECT id, round(count(*) / ((SELECT count(*) FROM z) - 1), 9) AS score, count(*) AS degree FROM q GROUP BY 1")
def degree_centrality(spark, d):
    return A.degree_centrality(_places(graph(spark, d))).select("id", F.round("score", 9).alias("score"), "degree")


_PR = _rounds(4, "r{i} AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS v FROM n)", "r{i} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(sum(r{j}.v / k.k), 0) AS v FROM n LEFT JOIN e ON e.o = n.id LEFT JOIN r{j} ON r{j}.id = e.s LEFT JOIN k ON k.s = e.s GROUP BY n.id)")


@query(f"WITH {SUPPLY}, k AS (SELECT s, count(*) AS k FROM e GROUP BY 1), {_PR} SELECT id, round(v, 9) AS score FROM r4")
def pagerank_fixed(spark, d):
    return A.pagerank(supply_graph(spark, d), rounds=4).select("id", F.round("score", 9).alias("score"))


def _ppr(edges: str) -> str:
    rounds = _rounds(3, "r{i} AS (SELECT 'Part:1' AS id, CAST(1.0 AS DOUBLE) AS v)", "r{i} AS (SELECT n.id, CASE WHEN n.id = 'Part:1' THEN 0.15 ELSE 0 END + 0.85 * coalesce(sum(r{j}.v / k.k), 0) AS v FROM n LEFT JOIN x ON x.o = n.id LEFT JOIN r{j} ON r{j}.id = x.s LEFT JOIN k ON k.s = x.s GROUP BY n.id)")
    return f"WITH {SUPPLY}, x AS ({edges}), k AS (SELECT s, count(*) AS k FROM x GROUP BY 1), {rounds} SELECT id, round(v, 9) AS score FROM r3 WHERE v > 0"


@query(_ppr("SELECT s, o FROM e"))
def ppr_fixed(spark, d):
    return A.personalized_pagerank(supply_graph(spark, d), ["Part:1"], rounds=3, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query(_ppr("SELECT s, o FROM e UNION ALL SELECT o, s FROM e"))
def ppr_bidirectional(spark, d):
    return A.personalized_pagerank(supply_graph(spark, d), ["Part:1"], rounds=3, tolerance=None, bidirectional=True).select("id", F.round("score", 9).alias("score"))


#: least labels spread over twice as many rounds as the graph is wide
_WCC = _rounds(12, "r{i} AS MATERIALIZED (SELECT id, id AS c FROM n)", "r{i} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT id, c FROM r{j} UNION ALL SELECT b.v, c FROM b JOIN r{j} ON b.u = r{j}.id) GROUP BY 1)")


@query(f"WITH {SUPPLY}, {_WCC} SELECT id, c AS component FROM r12")
def wcc(spark, d):
    return A.components(supply_graph(spark, d))


_CDLP = _rounds(3, "r{i} AS (SELECT id, id AS c FROM n)", "r{i} AS (SELECT u AS id, c FROM (SELECT u, c, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, c) AS k FROM b JOIN r{j} ON r{j}.id = b.v GROUP BY u, c) WHERE k = 1)")


@query(f"WITH {SUPPLY}, {_CDLP} SELECT id, c AS label FROM r3")
def cdlp(spark, d):
    return A.label_propagation(supply_graph(spark, d), 3)


def _co(spark, d) -> DataFrame:
    """Suppliers that share a part. Pairs are numbers until each is there once."""
    f = read_table(spark, d, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").select("l_partkey", "l_suppkey").distinct()
    pairs = Scratch(spark, "co").table(f.join(f.toDF("l_partkey", "other"), "l_partkey").where("l_suppkey < other").select("l_suppkey", "other").distinct(), "pairs")
    x, y = F.concat(F.lit("Supplier:"), "l_suppkey"), F.concat(F.lit("Supplier:"), "other")
    return pairs.select(F.least(x, y).alias("s"), F.lit("WITH").alias("p"), F.greatest(x, y).alias("o_id"), F.lit(1.0).alias("weight"))


_CO = "f AS (SELECT DISTINCT l_partkey AS p, 'Supplier:' || l_suppkey AS x FROM lineitem), c AS (SELECT DISTINCT a.x AS a, b.x AS b FROM f a JOIN f b USING (p) WHERE a.x < b.x)"


@query(f"WITH {_CO}, t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM c x JOIN c y ON x.b = y.a JOIN c z ON z.a = x.a AND z.b = y.b), m AS (SELECT unnest([i, j, k]) AS id FROM t), q AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM c UNION ALL SELECT b FROM c) GROUP BY 1), s AS (SELECT id, count(*) AS t FROM m GROUP BY 1) SELECT id, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END, 9) AS lcc FROM q LEFT JOIN s USING (id)")
def triangles_lcc(spark, d):
    return A.triangles(_co(spark, d)).select("id", "triangles", F.round("lcc", 9).alias("lcc"))


@query()
def kcore(spark, d):
    return A.k_core(supply_graph(spark, d))


@query(f"WITH {SUPPLY}, h1 AS (SELECT 'Part:1' AS src, v AS node FROM b WHERE u = 'Part:1'), h2 AS (SELECT DISTINCT b.v AS node FROM h1 JOIN b ON b.u = h1.node WHERE b.v <> 'Part:1' EXCEPT SELECT node FROM h1) SELECT 'Part:1' AS id, round(((SELECT count(*) FROM h1) + (SELECT count(*) FROM h2) / 2.0) / ((SELECT count(*) FROM n) - 1), 9) AS score")
def closeness_sample(spark, d):
    return A.closeness(supply_graph(spark, d), "harmonic", "both", 2, _seed(spark, "Part:1")).select("id", F.round("score", 9).alias("score"))


_EIG = _rounds(3, "r{i} AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS v FROM n)", "y{i} AS (SELECT n.id, coalesce(sum(r{j}.v), 0) AS v FROM n LEFT JOIN b ON b.v = n.id LEFT JOIN r{j} ON r{j}.id = b.u GROUP BY n.id), r{i} AS (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM y{i}) AS v FROM y{i})")


@query(f"WITH {SUPPLY}, {_EIG} SELECT id, round(v, 8) AS score FROM r3")
def eigenvector_fixed(spark, d):
    e = supply_graph(spark, d)
    return A.eigenvector(e.unionAll(e.select(F.col("o_id").alias("s"), "p", F.col("s").alias("o_id"), "weight")), 3).select("id", F.round("score", 8).alias("score"))


@query()
def betweenness(spark, d):
    return A.betweenness(supply_graph(spark, d), 50, "both").select("id", F.round("score", 6).alias("score"))


@query()
def leiden(spark, d):
    return A.communities(_co(spark, d))


# --- a directed graph with cycles: from each part of an order to the part of the order's next line
def _next_part(spark, d) -> DataFrame:
    item = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = item.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("then"))
    ident = lambda c: F.concat(F.lit("Part:"), c)
    return item.join(after, ["l_orderkey", "l_linenumber"]).select(ident("l_partkey").alias("s"), F.lit("THEN").alias("p"), ident("then").alias("o_id"), F.lit(1.0).alias("weight")).distinct()


_NEXT = "c AS (SELECT DISTINCT 'Part:' || a.l_partkey AS a, 'Part:' || b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)"


@query()
def scc(spark, d):
    return A.strong_components(_next_part(spark, d))


@query(f"WITH {_NEXT}, k AS (SELECT a, b FROM c WHERE a <> b), t AS (SELECT x.a AS i, x.b AS j, y.b AS l FROM k x JOIN k y ON x.b = y.a JOIN k z ON z.a = y.b AND z.b = x.a) SELECT DISTINCT unnest([i, j, l]) AS id FROM t")
def ring_detection(spark, d):
    return A.rings(_next_part(spark, d))


@query("SELECT 'Nation:' || c_nationkey AS id, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING count(*) > 2")
def hub_detection(spark, d):
    return graph(spark, d).cypher("MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:IN_NATION]->(n) WITH n, count(c) AS n2 WHERE n2 > 2 RETURN n.id AS id, n2 AS n")


# --- search
_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT x FROM v WHERE id = 3)"


def _vectors(spark, d) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query3(spark, d) -> list[float]:
    return search.vector_of(_vectors(spark, d), 3)


@query(f"WITH {_VEC} SELECT id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, q ORDER BY list_cosine_similarity(v.x, q.x) DESC, id LIMIT 10")
def knn(spark, d):
    return search.knn(_vectors(spark, d), _query3(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, q WHERE label = 1 ORDER BY list_cosine_similarity(v.x, q.x) DESC, id LIMIT 10")
def knn_label(spark, d):
    return search.knn(_vectors(spark, d).where("label = 1"), _query3(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, q WHERE id <> 3 ORDER BY list_cosine_similarity(v.x, q.x) DESC, id LIMIT 10")
def knn_by_id(spark, d):
    return search.knn_by_id(_vectors(spark, d), 3).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT id, round(list_dot_product(v.x, q.x), 6) AS score FROM v, q ORDER BY list_dot_product(v.x, q.x) DESC, id LIMIT 10")
def knn_dot(spark, d):
    return search.knn(_vectors(spark, d), _query3(spark, d), by="dot").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT id, round(1 / (1 + list_distance(v.x, q.x)), 6) AS score FROM v, q ORDER BY list_distance(v.x, q.x), id LIMIT 10")
def knn_l2(spark, d):
    return search.knn(_vectors(spark, d), _query3(spark, d), by="l2").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT count(*) AS n FROM v, q WHERE list_cosine_similarity(v.x, q.x) >= 0.2")
def vector_threshold(spark, d):
    return search.knn(_vectors(spark, d), _query3(spark, d), 1_000_000, threshold=0.2).agg(F.count("*").alias("n"))


@query(f"WITH {_VEC} SELECT id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, q ORDER BY list_cosine_similarity(v.x, q.x) DESC, id LIMIT 10")
def ivf_all_probe(spark, d):
    return search.IVF(_vectors(spark, d), 8).search(_query3(spark, d), 10, 8).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC}, t AS (SELECT id // 5 AS id, x FROM v), z AS (SELECT id AS qid, x AS qx FROM v WHERE id < 3), m AS (SELECT t.id, qid, max(list_dot_product(t.x, qx)) AS s FROM t, z GROUP BY 1, 2) SELECT CAST(id AS BIGINT) AS id, round(sum(s), 6) AS score FROM m GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10")
def plaid_maxsim(spark, d):
    v = _vectors(spark, d)
    asked = [list(r[0]) for r in v.where("id < 3").orderBy("id").select("embedding").collect()]
    return search.maxsim(v.select(F.floor(F.col("id") / 5).alias("id"), F.col("embedding").alias("token")), asked).select("id", F.round("score", 6).alias("score"))


TERMS = "the thing ndon"
_BM = "w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), l AS (SELECT id, len(t) AS len, t FROM w WHERE len(t) > 0), c AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(t) AS term FROM l) GROUP BY ALL), z AS (SELECT count(*) AS n, avg(len) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), bm AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM c JOIN df USING (term), z WHERE term IN ('the', 'thing', 'ndon') GROUP BY 1)"


def _index(spark, d) -> search.BM25:
    return search.BM25(read_table(spark, d, "documents"), "doc_id")


@query(f"WITH {_BM} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def bm25(spark, d):
    return _index(spark, d).search(TERMS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM}, {_VEC}, a AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(v.x, q.x) DESC, id) AS r FROM v, q), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm), u AS (SELECT id, 1 / (60 + r) AS s FROM a WHERE r <= 20 UNION ALL SELECT id, 1 / (60 + r) FROM b WHERE r <= 20) SELECT id, round(sum(s), 9) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10")
def hybrid_retrieve(spark, d):
    return search.hybrid(_vectors(spark, d), _query3(spark, d), _index(spark, d), TERMS).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_BM}, {_VEC}, a AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(v.x, q.x) DESC, id) AS r FROM v, q), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm), u AS (SELECT coalesce(a.id, b.id) AS id, 1 / (60 + coalesce(a.r, 1000000000)) + 1 / (60 + coalesce(b.r, 1000000000)) AS s FROM (FROM a WHERE r <= 50) a FULL JOIN (FROM b WHERE r <= 50) b ON a.id = b.id) SELECT id, round(s, 9) AS score FROM u ORDER BY s DESC, id LIMIT 10")
def rrf_sql(spark, d):
    return search.rrf_outer(search.knn(_vectors(spark, d), _query3(spark, d), 50), _index(spark, d).search(TERMS, 50)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_VEC}, m AS (SELECT id, label, list_cosine_similarity(v.x, q.x) AS c FROM v, q), a AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM m WHERE label = 0 QUALIFY r <= 20), b AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM m QUALIFY r <= 20), u AS (SELECT id, 2.0 / (60 + r) AS s FROM a UNION ALL SELECT id, 1.0 / (60 + r) FROM b) SELECT id, round(sum(s), 9) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10")
def multi_vector_rrf(spark, d):
    v = _vectors(spark, d)
    return search.multi_vector([(v.where("label = 0"), 2.0), (v, 1.0)], _query3(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {EVENTS}, {_VEC}, n AS (SELECT DISTINCT CAST(substr(o, 3) AS BIGINT) AS id FROM t WHERE s = 'user:8' AND o IS NOT NULL) SELECT id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v SEMI JOIN n USING (id), q ORDER BY list_cosine_similarity(v.x, q.x) DESC, id LIMIT 10")
def bfs_vector_rerank(spark, d):
    met = traversal.reach(temporal_edges(spark, d).select("s", F.col("o").alias("o_id")).where("o_id IS NOT NULL"), _seed(spark, "user:8"), 1, 1)
    return search.rerank_by_vector(met.select(F.substring("node", 3, 20).cast("long").alias("id")), _vectors(spark, d), _query3(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("WITH g AS (SELECT 'Part:' || l_partkey AS id, 'Supplier:' || l_suppkey AS o, floor(1000 * (1 - max(l_discount))) AS c FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT id, round(max(c / 1000 + CASE WHEN contains(lower(o), 'supplier:7') THEN 0.5 ELSE 0 END), 6) AS score FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def txt_qualifier(spark, d):
    return search.text_edges(graph(spark, d).edge_view(["SUPPLIED_BY"]), "supplier:7").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM}, {_VEC}, u AS (SELECT id, 0.75 * list_cosine_similarity(v.x, q.x) AS s FROM v, q UNION ALL SELECT id, 0.25 * score FROM bm) SELECT id, round(sum(s), 6) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10")
def weighted_fusion(spark, d):
    return search.weighted_fusion([search.knn(_vectors(spark, d), _query3(spark, d), 1_000_000), _index(spark, d).scored(TERMS)], [3, 1]).select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id, CASE WHEN contains(upper(p_name), '12') THEN 1.0 ELSE 0.8 END AS score FROM part WHERE contains(upper(p_name), '12') OR contains(upper(p_brand), '12') ORDER BY 2 DESC, length(CASE WHEN contains(upper(p_name), '12') THEN p_name ELSE p_brand END), 1 LIMIT 10")
def txt_like(spark, d):
    return search.text_like(read_table(spark, d, "part"), "12", 10, ("p_name", "p_brand"), id_column="p_partkey").withColumn("score", F.col("score").cast("double"))


# --- temporal
@query(f"WITH {EVENTS} SELECT ts, s, p, o, w FROM t WHERE ts BETWEEN {START} AND {END} AND s = 'user:3'")
def window_out(spark, d):
    return temporal.window(temporal_edges(spark, d), START, END, "user:3").drop("attrs")


@query(f"WITH {EVENTS} SELECT ts, s, p, o, w FROM t WHERE ts BETWEEN {START} AND {END} AND o = 'k:3'")
def window_in(spark, d):
    return temporal.window(temporal_edges(spark, d), START, END, "k:3", None, "in").drop("attrs")


@query(f"WITH {EVENTS} SELECT s, count(*) AS n FROM t WHERE p = 'click' AND ts >= {START} AND ts <= {END} GROUP BY 1")
def temporal_cypher(spark, d):
    from trellis.plans.graph import EdgeTable

    e = temporal_edges(spark, d).select("s", F.col("o").alias("o_id"), "p", "ts", "w")
    g = Graph(spark, edges={"click": EdgeTable(e.where("p = 'click'").drop("p"))})
    return g.cypher("MATCH (a)-[r:click]->(b) WHERE r.ts >= $a AND r.ts <= $b RETURN a.id AS s, count(*) AS n", a=START, b=END)


@query(f"WITH {EVENTS} SELECT count(*) AS n, round(sum(w), 4) AS sum, round(avg(w), 4) AS avg, min(w) AS min, max(w) AS max FROM t WHERE ts // 300 BETWEEN {START} // 300 AND {END} // 300")
def bucket_agg(spark, d):
    return temporal.aggregate(temporal_edges(spark, d), START, END).select("n", F.round("sum", 4).alias("sum"), F.round("avg", 4).alias("avg"), "min", "max")


@query(f"WITH {EVENTS} SELECT s, p, count(*) AS n, round(sum(w), 4) AS sum, round(avg(w), 4) AS avg, min(w) AS min, max(w) AS max FROM t WHERE ts // 300 BETWEEN {START} // 300 AND {END} // 300 AND starts_with(s, 'user:1') GROUP BY 1, 2")
def bucket_groups(spark, d):
    return temporal.bucket_groups(temporal_edges(spark, d), START, END, None, "user:1").select("s", "p", "n", F.round("sum", 4).alias("sum"), F.round("avg", 4).alias("avg"), "min", "max")


@query(f"WITH {EVENTS} SELECT DISTINCT o FROM t WHERE s = 'user:3' AND p = 'click' AND ts BETWEEN {START} AND {END * 2}")
def bucket_targets(spark, d):
    return temporal.targets(temporal_edges(spark, d), "user:3", "click", START, END * 2)


@query(f"WITH {EVENTS} SELECT s, p, count(DISTINCT o) AS n FROM t WHERE ts BETWEEN {START} AND {END * 2} GROUP BY 1, 2")
def distinct_targets(spark, d):
    return temporal.distinct_targets(temporal_edges(spark, d), START, END * 2)


@query(f"WITH {EVENTS} SELECT count(*) AS n FROM t WHERE s = 'user:3' AND ts // 300 BETWEEN ({NOW} - 86400) // 300 AND {NOW} // 300")
def velocity(spark, d):
    return temporal.velocity(temporal_edges(spark, d), "user:3", NOW, 86_400)


@query(f"WITH {EVENTS} SELECT s, count(*) AS n FROM t WHERE ts // 300 BETWEEN ({NOW} - 864000) // 300 AND {NOW} // 300 GROUP BY 1 HAVING count(*) >= 2")
def burst_nodes(spark, d):
    return temporal.bursts(temporal_edges(spark, d), NOW, 864_000, 2)


@query(f"WITH {EVENTS} SELECT count(*) AS n FROM t WHERE ts > {NOW}")
def purge_before(spark, d):
    return temporal.purge_before(temporal_edges(spark, d), NOW).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT DISTINCT s AS src, o AS node, 1 AS hop FROM t WHERE s IN ('user:1', 'user:2') AND ts BETWEEN {START} AND {END * 2}")
def temporal_bfs(spark, d):
    return temporal.temporal_reach(temporal_edges(spark, d), _seed(spark, "user:1", "user:2"), START, END * 2)


@query(f"WITH {EVENTS} SELECT s, count(*) FILTER (ts > {NOW} - 86400) AS n_24h, round(coalesce(sum(w) FILTER (ts > {NOW} - 86400), 0), 4) AS sum_24h, count(DISTINCT o) AS targets_7d FROM t WHERE ts > {NOW} - 604800 AND ts <= {NOW} GROUP BY 1")
def rolling_features(spark, d):
    return temporal.rolling(temporal_edges(spark, d), NOW).withColumn("sum_24h", F.round("sum_24h", 4))


@query(f"WITH {EVENTS} SELECT ts // 300 * 300 AS start, s, p, count(*) AS n, round(sum(w), 4) AS sum, min(w) AS min, max(w) AS max FROM t GROUP BY 1, 2, 3")
def streaming_buckets(spark, d):
    from trellis.streaming import buckets

    raw = buckets.read(spark, f"{d}/events.parquet*", read_table(spark, d, "events").schema)
    e = raw.select(F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("user:"), "user_id").alias("s"), F.col("event_type").alias("p"), F.col("value").alias("w"))
    return buckets.buckets_available(e).withColumn("sum", F.round("sum", 4))


# --- writes and semantics
def _store(spark, d) -> mutate.Store:
    g = graph(spark, d)
    nodes = {k: g.nodes[k] for k in ("Region", "Nation")}
    small = Graph(spark, nodes, {"IN_REGION": g.edges["IN_REGION"]})
    return mutate.Store(small.node_view().select("node_id"), small.label_view(), small.prop_view(), small.edge_view().select("s", "p", "o_id", "weight"))


_NEW = [("Region:0", ["Region", "Old"], {"seen": "1"}), ("Region:9", ["Region"], {"r_name": "NOWHERE"})]


@query("SELECT 'Region:' || r_regionkey AS node_id, 'm' AS mark FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'Region:9', 'c'")
def merge_nodes(spark, d):
    new = spark.createDataFrame(_NEW, "node_id string, labels array<string>, props map<string,string>")
    return _store(spark, d).merge_nodes(new, {"mark": "c"}, {"mark": "m"}).props.where("key = 'mark'").select(F.col("s").alias("node_id"), F.col("val").alias("mark"))


@query("SELECT 'Region:' || r_regionkey AS s, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS val FROM region")
def set_props(spark, d):
    change = spark.createDataFrame([("Region:1", "r_name", "X")], "s string, key string, val string")
    return _store(spark, d).set_props(change).props.where("key = 'r_name'").select("s", "val")


@query("SELECT 'Region:' || r_regionkey AS s FROM region WHERE r_regionkey <> 1")
def remove_props(spark, d):
    gone = spark.createDataFrame([("Region:1", "r_name")], "s string, key string")
    return _store(spark, d).remove_props(gone).props.where("key = 'r_name'").select("s")


@query("SELECT 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS o_id FROM nation WHERE n_regionkey <> 2")
def detach_delete(spark, d):
    return _store(spark, d).delete_nodes(spark.createDataFrame([("Region:2",)], "node_id string"), detach=True).edges.select("s", "o_id")


@query("SELECT 'Nation:' || n_nationkey AS s, 'rdf:type' AS p, unnest(['Place', 'Thing', 'Area']) AS o_id FROM nation UNION ALL SELECT 'Area', 'rdfs:subClassOf', 'Thing'")
def rdfs_closure(spark, d):
    facts = read_table(spark, d, "nation").select(F.concat(F.lit("Nation:"), "n_nationkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("Country").alias("o_id"))
    rules = spark.createDataFrame([("Country", "rdfs:subClassOf", "Place"), ("Country", "rdfs:subClassOf", "Area"), ("Area", "rdfs:subClassOf", "Place2"), ("Place", "rdfs:subClassOf", "Thing"), ("Area", "rdfs:subClassOf", "Place")], "s string, p string, o_id string").where("o_id <> 'Place2'")
    return inference.materialize(facts.unionAll(rules)).where("inferred AND NOT (s = 'Country')").select("s", "p", "o_id")


@query("SELECT 'Region:' || n_regionkey AS s, 'hasNation' AS p, 'Nation:' || n_nationkey AS o_id FROM nation")
def owl_inverse(spark, d):
    facts = graph(spark, d).edge_view(["IN_REGION"]).select("s", "p", "o_id")
    rules = spark.createDataFrame([("IN_REGION", "owl:inverseOf", "hasNation")], "s string, p string, o_id string")
    return inference.materialize(facts.unionAll(rules), "owl").where("inferred AND p = 'hasNation'").select("s", "p", "o_id")


@query("SELECT 'reif:' || substring(sha256('Nation:' || n_nationkey || '|IN_REGION|Region:' || n_regionkey), 1, 16) AS reifier_id, 'Nation:' || n_nationkey AS s, 'IN_REGION' AS p, 'Region:' || n_regionkey AS o_id FROM nation")
def reify(spark, d):
    return mutate.reify(graph(spark, d).edge_view(["IN_REGION"]))


@query("SELECT '<urn:trellis:Nation:' || n_nationkey || '> <urn:trellis:IN_REGION> <urn:trellis:Region:' || n_regionkey || '> .' AS value FROM nation")
def rdf_lines(spark, d):
    return formats.rdf_lines(edges=graph(spark, d).edge_view(["IN_REGION"]))


@query("SELECT count(*) * 4 AS n FROM events")
def prov_lines(spark, d):
    return formats.prov_lines(temporal_edges(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT 'Nation:' || n_nationkey AS s, 'IN_REGION' AS p, 'Region:' || n_regionkey AS o_id FROM nation")
def ndjson_roundtrip(spark, d):
    import uuid

    from trellis.storage import shared_dir

    path = f"{shared_dir(spark)}/ndjson-{uuid.uuid4().hex}"
    g = graph(spark, d)
    formats.write_lines(formats.ndjson_lines(g.node_view().where("array_contains(labels, 'Nation')"), g.edge_view(["IN_REGION"])), path)
    return formats.read_ndjson(spark, path)["edges"]


@query("SELECT 'Supplier:' || s_suppkey AS focus, 's_acctbal' AS path, 'pattern' AS constraint FROM supplier WHERE s_acctbal < 0")
def shacl_checks(spark, d):
    return inference.shacl(graph(spark, d).node_view(), "Supplier", [{"path": "s_acctbal", "min": 1, "datatype": "double", "pattern": "^[0-9]"}])


# --- AQL
@query("SELECT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def aql_traversal(spark, d):
    return graph(spark, d).aql("FOR v IN 1..1 OUTBOUND 'Customer:5' IN_NATION RETURN {name: v.n_name}")


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def aql_collect(spark, d):
    return graph(spark, d).aql("FOR c IN Customer FILTER c.c_acctbal > @low COLLECT seg = c.c_mktsegment WITH COUNT INTO n RETURN {seg: seg, n: n}", low=100)
