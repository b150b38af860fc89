"""Cypher over the driver's tables: (text, parameters, SQL)."""

from __future__ import annotations

from trellis.sources.tables import graph

_N, _C, _O, _S = "n_nationkey", "c_custkey", "o_orderkey", "s_suppkey"
#: name: (cypher, parameters, SQL for DuckDB)
CASES: dict[str, tuple[str, dict, str]] = {
    "match_chain": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = $x RETURN n.n_name AS nation, count(c) AS customers ORDER BY customers DESC, nation LIMIT 10", {"x": "ASIA"},
        "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "match_label": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name", {}, "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "match_label_or": ("MATCH (x:Customer|Supplier) RETURN count(*) AS n", {}, "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "match_multi_label": ("MATCH (x:Customer:Supplier) RETURN count(*) AS n", {}, "SELECT CAST(0 AS BIGINT) AS n"),
    "match_prop": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.id AS id, c.c_acctbal AS bal", {}, "SELECT 'Customer:' || c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, sum(o.o_totalprice) AS total", {}, "SELECT o_custkey AS c, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "hop_in": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS nation, count(c) AS n", {}, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "hop_both": ("MATCH (n:Nation {n_nationkey: 3})-[:IN_REGION|IN_NATION]-(x) RETURN x.id AS id", {}, "SELECT 'Region:' || n_regionkey AS id FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'Customer:' || c_custkey FROM customer WHERE c_nationkey = 3"),
    "hop_multi_type": ("MATCH (x)-[r:IN_NATION|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, type(r) AS kind, count(*) AS n", {}, "SELECT n_name AS nation, kind, count(*) AS n FROM (SELECT c_nationkey AS k, 'IN_NATION' AS kind FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2"),
    "chain_3": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN c.c_custkey AS c, count(DISTINCT p) AS parts", {}, "SELECT o_custkey AS c, count(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "cycle_close": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:BASED_IN]-(s:Supplier)<-[:SUPPLIED_BY]-(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN c.c_custkey AS c, count(*) AS n", {},
        "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN e ON l_orderkey = o_orderkey JOIN f ON e.l_partkey = f.l_partkey JOIN supplier ON s_suppkey = f.l_suppkey AND s_nationkey = c_nationkey GROUP BY 1"),
    "multi_pattern": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS nation, count(*) AS pairs", {}, "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:BASED_IN]->(n) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, count(s) AS n", {}, "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1"),
    "mapped_via": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.weight > 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.weight AS w", {}, "SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) > 45"),
    "qualifier_filter": ("MATCH (p:Part)-[r:SUPPLIED_BY]->(s:Supplier) WHERE r.confidence >= 990 RETURN s.s_suppkey AS s, count(*) AS n", {}, "SELECT l_suppkey AS s, count(*) AS n FROM (SELECT l_partkey, l_suppkey, floor(1000 * (1 - max(l_discount))) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE c >= 990 GROUP BY 1"),
    "theta_pattern": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b", {}, "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey"),
    "where_range": ("MATCH (o:Order) WHERE o.o_totalprice >= 100000 AND o.o_totalprice < 200000 RETURN count(*) AS n, avg(o.o_totalprice) AS mean", {}, "SELECT count(*) AS n, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000"),
    "where_bool_xor": ("MATCH (c:Customer) WHERE c.c_acctbal > 0 XOR c.c_mktsegment = 'BUILDING' RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 0) <> (c_mktsegment = 'BUILDING')"),
    "where_in": ("MATCH (n:Nation) WHERE n.n_nationkey IN $keys RETURN n.n_name AS name", {"keys": [1, 2, 5]}, "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 2, 5)"),
    "where_in_empty": ("MATCH (n:Nation) WHERE n.n_nationkey IN [] RETURN count(*) AS n", {}, "SELECT CAST(0 AS BIGINT) AS n"),
    "where_strings": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'Part' OR p.p_type CONTAINS 'STEEL' OR p.p_brand ENDS WITH '3' RETURN p.p_partkey AS k", {}, "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'Part') OR contains(p_type, 'STEEL') OR ends_with(p_brand, '3')"),
    "where_regex": ("MATCH (p:Part) WHERE p.p_brand =~ 'Brand#[12]+' RETURN p.p_partkey AS k", {}, "SELECT p_partkey AS k FROM part WHERE regexp_full_match(p_brand, 'Brand#[12]+')"),
    "where_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus: 'P'}) WITH c, o WHERE o IS NULL RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "where_label": ("MATCH (n) WHERE n:Region OR n.n_nationkey = '7' RETURN n.id AS id", {}, "SELECT 'Region:' || r_regionkey AS id FROM region UNION ALL SELECT 'Nation:7'"),
    "exists_pattern": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 } RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "not_exists_pattern": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Order {o_orderstatus: 'P'}) } RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_in_or": ("MATCH (c:Customer) WHERE c.c_acctbal > 9500 OR EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "case_when": ("MATCH (c:Customer) RETURN CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, count(*) AS n", {}, "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, count(*) AS n FROM customer GROUP BY 1"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n", {}, "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n FROM orders GROUP BY 1"),
    "params_skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP $s LIMIT $n", {"s": 10, "n": 5}, "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 5 OFFSET 10"),
    "return_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s", {}, "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "with_group_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.c_name AS name, n", {}, "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_star": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH * WHERE r.r_regionkey = 2 RETURN n.n_name AS n, r.r_name AS r", {}, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2"),
    "with_order_limit": ("MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n", {}, "SELECT n_name AS nation, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "implicit_group": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) AS n, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high", {}, "SELECT o_orderpriority AS p, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1"),
    "order_skip_limit": ("MATCH (s:Supplier) RETURN s.s_name AS name, s.s_acctbal AS bal ORDER BY bal DESC, name SKIP 3 LIMIT 7", {}, "SELECT s_name AS name, s_acctbal AS bal FROM supplier ORDER BY 2 DESC, 1 LIMIT 7 OFFSET 3"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", {}, "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", {}, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "unwind": ("UNWIND [1, 3, 5] AS k MATCH (n:Nation) WHERE n.n_nationkey = k RETURN k, n.n_name AS name", {}, "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5)"),
    "call_scalar": ("MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN count(o) AS n } RETURN c.c_custkey AS k, n", {}, "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1"),
    "call_lateral": ("MATCH (n:Nation) CALL { WITH n MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN s.s_name AS s, s.s_acctbal AS b } RETURN n.n_name AS n, s, b", {}, "SELECT n_name AS n, s_name AS s, s_acctbal AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "call_uncorrelated": ("CALL { MATCH (r:Region) RETURN count(r) AS regions } MATCH (n:Nation) RETURN n.n_name AS n, regions", {}, "SELECT n_name AS n, (SELECT count(*) FROM region) AS regions FROM nation"),
    "node_expand": ("MATCH (r:Region) RETURN r", {}, "SELECT 'Region:' || r_regionkey AS r_id, ['Region'] AS r_labels, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":\"' || r_regionkey || '\"}' AS r_props FROM region"),
    "named_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN length(p) AS len, p", {}, "SELECT 2 AS len, '{\"nodes\":[\"Customer:' || c_custkey || '\",\"Nation:' || n_nationkey || '\",\"Region:' || n_regionkey || '\"],\"rels\":[\"IN_NATION\",\"IN_REGION\"],\"length\":2}' AS p FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "agg_basic": ("MATCH (o:Order) RETURN count(*) AS n, sum(o.o_totalprice) AS s, avg(o.o_totalprice) AS a, min(o.o_orderkey) AS lo, max(o.o_orderkey) AS hi", {}, "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders"),
    "agg_distinct": ("MATCH (o:Order) RETURN count(DISTINCT o.o_custkey) AS customers, count(DISTINCT o.o_orderstatus) AS states", {}, "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders"),
    "collect_sorted": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, collect(n.n_name) AS names", {}, "SELECT r_name AS r, list_sort(list(n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "stdev": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, round(stdev(c.c_acctbal), 4) AS sd, round(stdevp(c.c_acctbal), 4) AS sdp", {}, "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp FROM customer GROUP BY 1"),
    "percentiles": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, round(percentileCont(o.o_totalprice, 0.9), 4) AS cont, percentileDisc(o.o_totalprice, 0.5) AS disc", {}, "SELECT o_orderstatus AS s, round(quantile_cont(o_totalprice, 0.9), 4) AS cont, quantile_disc(o_totalprice, 0.5) AS disc FROM orders GROUP BY 1"),
    "fn_string": ("MATCH (n:Nation) RETURN toLower(n.n_name) AS lo, toUpper(n.n_name) AS up, substring(n.n_name, 1, 3) AS sub, left(n.n_name, 2) AS l, right(n.n_name, 2) AS r, replace(n.n_name, 'N', 'x') AS rep, reverse(n.n_name) AS rev, size(n.n_name) AS len, split(n.n_name, '_') AS parts, trim('  a ') AS t", {},
        "SELECT lower(n_name) AS lo, upper(n_name) AS up, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS l, right(n_name, 2) AS r, replace(n_name, 'N', 'x') AS rep, reverse(n_name) AS rev, CAST(length(n_name) AS INTEGER) AS len, string_split(n_name, '_') AS parts, 'a' AS t FROM nation"),
    "fn_math": ("MATCH (s:Supplier) RETURN abs(s.s_acctbal) AS a, ceil(s.s_acctbal) AS c, floor(s.s_acctbal) AS f, round(sqrt(abs(s.s_acctbal)), 6) AS q, sign(s.s_acctbal) AS g, s.s_suppkey % 7 AS m, round(2 ^ 3, 2) AS p", {}, "SELECT abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, CAST(sign(s_acctbal) AS INTEGER) AS g, s_suppkey % 7 AS m, CAST(8.0 AS DOUBLE) AS p FROM supplier"),
    "fn_convert": ("MATCH (n:Nation) RETURN toInteger('12') + n.n_nationkey AS i, toFloat('1.5') AS f, toString(n.n_nationkey) AS s, toBoolean('yes') AS b, toInteger('x') AS bad", {}, "SELECT CAST(12 + n_nationkey AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, CAST(n_nationkey AS VARCHAR) AS s, true AS b, CAST(NULL AS BIGINT) AS bad FROM nation"),
    "fn_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, coalesce(max(o.o_totalprice), 0.0) AS top", {}, "SELECT c_custkey AS k, coalesce(max(o_totalprice), 0.0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "fn_list": ("MATCH (r:Region) RETURN r.r_regionkey AS k, head([1, 2, 3]) AS h, last([1, 2, 3]) AS l, tail([1, 2, 3]) AS t, range(1, 4) AS g, [1, 2, 3][0] AS first, [1, 2, 3, 4][1..3] AS cut, size([1, 2]) AS n", {}, "SELECT r_regionkey AS k, 1 AS h, 3 AS l, [2, 3] AS t, [1, 2, 3, 4] AS g, 1 AS first, [2, 3] AS cut, 2 AS n FROM region"),
    "list_comprehension": ("MATCH (r:Region) RETURN r.r_regionkey AS k, [x IN range(1, 5) WHERE x > r.r_regionkey | x * 10] AS xs", {}, "SELECT r_regionkey AS k, list_transform(list_filter([1, 2, 3, 4, 5], lambda x: x > r_regionkey), lambda x: x * 10) AS xs FROM region"),
    "list_predicates": ("MATCH (r:Region) RETURN r.r_regionkey AS k, any(x IN [0, 2] WHERE x = r.r_regionkey) AS a, all(x IN [0, 2] WHERE x <= r.r_regionkey) AS b, none(x IN [0, 2] WHERE x = r.r_regionkey) AS c, single(x IN [0, 2, 2] WHERE x = r.r_regionkey) AS d", {}, "SELECT r_regionkey AS k, r_regionkey IN (0, 2) AS a, r_regionkey >= 2 AS b, r_regionkey NOT IN (0, 2) AS c, r_regionkey = 0 AS d FROM region"),
    "reduce": ("MATCH (r:Region) RETURN r.r_regionkey AS k, reduce(p = 1, x IN [2, 3] | p * x + r.r_regionkey) AS v", {}, "SELECT r_regionkey AS k, CAST((2 + r_regionkey) * 3 + r_regionkey AS DOUBLE) AS v FROM region"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.r_name AS r, [(n:Nation)-[:IN_REGION]->(r) | n.n_name] AS names", {}, "SELECT r_name AS r, list_sort(list(n_name)) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "map_projection": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n{.n_name, key: n.n_nationkey} AS m", {}, "SELECT n_nationkey AS k, '{\"n_name\":\"' || n_name || '\",\"key\":' || n_nationkey || '}' AS m FROM nation"),
    "keys_labels": ("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.id AS id, labels(n) AS l, type(r) AS t, startNode(r) AS s, endNode(r) AS e", {}, "SELECT 'Nation:' || n_nationkey AS id, ['Nation'] AS l, 'IN_REGION' AS t, 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS e FROM nation"),
    "eav_range": ("MATCH (n) WHERE n.s_acctbal > 9000 RETURN n.id AS id", {}, "SELECT 'Supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal > 9000"),
    "bfs_1_3": ("MATCH (c:Customer {c_custkey: 7})-[:PLACED|CONTAINS|SUPPLIED_BY*1..3]->(x) RETURN x.id AS id", {}, "WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey = 7), p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN p USING (l_partkey)) SELECT 'Order:' || o_orderkey AS id FROM o UNION ALL SELECT 'Part:' || l_partkey FROM p UNION ALL SELECT 'Supplier:' || l_suppkey FROM s"),
    "bfs_in": ("MATCH (r:Region {r_regionkey: 1})<-[:IN_REGION|IN_NATION*2..2]-(x) RETURN x.id AS id", {}, "SELECT 'Customer:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"),
    "approx_distinct": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN approx_count_distinct(p.p_partkey) AS n", {}, ""),
    "db_labels": ("CALL db.labels() YIELD label RETURN label", {}, "SELECT unnest(['Customer', 'Nation', 'Order', 'Part', 'Region', 'Supplier']) AS label"),
    "db_reltypes": ("CALL db.relationshipTypes() YIELD relationshipType AS t RETURN t", {}, "SELECT unnest(['BASED_IN', 'CONTAINS', 'IN_NATION', 'IN_REGION', 'PLACED', 'SUPPLIED_BY']) AS t"),
    "db_propertykeys": ("CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 'n_' OR k STARTS WITH 'r_' RETURN k", {}, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'r_regionkey', 'r_name']) AS k"),
    "db_nodetypeproperties": ("CALL db.schema.nodeTypeProperties() YIELD nodeLabel AS l, propertyName AS p WHERE l = 'Region' RETURN l, p", {}, "SELECT 'Region' AS l, unnest(['r_regionkey', 'r_name']) AS p"),
    "call_then_match": ("CALL graph.neighbors('Nation:3', 'IN_REGION', 'out') YIELD node AS r MATCH (x:Nation)-[:IN_REGION]->(r) RETURN x.n_name AS n", {}, "SELECT n_name AS n FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)"),
}


def _query(text: str, params: dict):
    return lambda spark, sf_dir: graph(spark, sf_dir).cypher(text, **params)


QUERIES = {k: _query(text, params) for k, (text, params, _) in CASES.items()}
ORACLE_SQL = {k: sql for k, (_, _, sql) in CASES.items() if sql}
