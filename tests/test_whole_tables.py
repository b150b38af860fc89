"""Queries over all of the tables, on small tables whose results are worked out the long way."""

from collections import defaultdict

import pytest

from tests.test_algorithms import distances, table
from trellis.queries import QUERIES

SUPPLY = [(p, s) for p in (1, 70, 90, 400) for s in (1, 2, 3, 4)] + [(p, s) for p in (80, 500) for s in (11, 12, 13)] + [(900, 4), (901, 4), (902, 21)]


@pytest.fixture(scope="module")
def supply(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("supply")
    rows = [(k // 3, p, s, k % 3 + 1, 1.0, 0.0) for k, (p, s) in enumerate(SUPPLY)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def adjacency():
    out = defaultdict(set)
    for p, s in SUPPLY:
        out[f"Part:{p}"].add(f"Supplier:{s}")
        out[f"Supplier:{s}"].add(f"Part:{p}")
    return out


def cores():
    near, out = adjacency(), {}
    for k in range(1, 20):
        while low := [v for v in near if len(near[v]) < k]:
            for v in low:
                out[v] = k - 1
                for u in near.pop(v):
                    if u in near:
                        near[u].discard(v)
    return out


def test_kcore_of_all_parts(spark, supply):
    assert table(QUERIES["kcore"](spark, supply), value="coreness") == cores()


def test_wcc_of_all_parts(spark, supply):
    near, want = adjacency(), {}
    for root in sorted(near):
        stack = [root]
        while stack:
            v = stack.pop()
            if v not in want:
                want[v] = root
                stack += near[v]
    assert table(QUERIES["wcc"](spark, supply), value="component") == want


def test_betweenness_of_all_parts(spark, supply):
    near, want = adjacency(), defaultdict(float)
    for s in near:  # fewer nodes than the sample, so that every node is a source
        far, ways, order = {s: 0}, defaultdict(int, {s: 1}), [s]
        for v in order:
            for u in near[v]:
                if u not in far:
                    far[u] = far[v] + 1
                    order.append(u)
                if far[u] == far[v] + 1:
                    ways[u] += ways[v]
        share = defaultdict(float)
        for u in reversed(order):
            for v in near[u]:
                if far[v] + 1 == far[u]:
                    share[v] += ways[v] / ways[u] * (1 + share[u])
        for v in far.keys() - {s}:
            want[v] += share[v]
    got = table(QUERIES["betweenness"](spark, supply), value="score")
    assert got.keys() == near.keys() and all(abs(got[v] - want[v]) < 1e-5 for v in got)


def test_leiden_of_all_parts(spark, supply):
    groups = defaultdict(set)
    for v, c in table(QUERIES["leiden"](spark, supply), value="community").items():
        groups[c].add(v)
    assert sorted(map(sorted, groups.values())) == [[f"Supplier:{s}" for s in (1, 2, 3, 4)], [f"Supplier:{s}" for s in (11, 12, 13)]]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Lines of orders: a ring of three and one of four parts joined by an edge, one of two, and parts in a row."""
    d = tmp_path_factory.mktemp("orders")
    lists = [(70, 90), (90, 400), (400, 70, 70), (400, 500), (500, 510, 520, 530, 500), (600, 610, 600), (610, 700, 701, 702), (703, 703)]
    rows = [(k, p, 1, i + 1, 1.0, 0.0) for k, ps in enumerate(lists) for i, p in enumerate(ps)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return str(d), sorted({(f"Part:{a}", f"Part:{b}") for ps in lists for a, b in zip(ps, ps[1:], strict=False)})


def test_scc_of_a_graph_with_cycles(spark, orders):
    d, pairs = orders
    nodes = sorted({x for p in pairs for x in p})
    far = {v: distances(pairs, v) for v in nodes}
    want = {v: min(u for u in nodes if u in far[v] and v in far[u]) for v in nodes}
    assert sorted(map(list(want.values()).count, set(want.values())))[-3:] == [2, 3, 4]
    assert table(QUERIES["scc"](spark, d), value="component") == want


def test_scc_of_the_driver_tables(spark, sf):
    e = [(f"Part:{r[0]}", f"Part:{r[1]}") for r in spark.sql(f"SELECT DISTINCT a.l_partkey, b.l_partkey FROM parquet.`{sf}/lineitem.parquet` a JOIN parquet.`{sf}/lineitem.parquet` b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber").collect()]
    out = defaultdict(set)
    for a, b in e:
        out[a].add(b)
    far = {}
    for v in {x for p in e for x in p}:
        far[v], stack = {v}, [v]
        while stack:
            for u in out[stack.pop()] - far[v]:
                far[v].add(u)
                stack.append(u)
    want = {v: min(u for u in far[v] if v in far[u]) for v in far}
    assert table(QUERIES["scc"](spark, sf), value="component") == want


def test_rings_of_three(spark, orders):
    assert sorted(r.id for r in QUERIES["ring_detection"](spark, orders[0]).collect()) == ["Part:400", "Part:70", "Part:90"]


def test_long_paths_of_all_conversations(spark, tmp_path):
    turns = {0: 2, 4: 1, 7: 6, 400: 9}
    rows = [(c, t, "user", "x") for c, n in turns.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = table(QUERIES["long_paths"](spark, str(tmp_path)), "src", "hops")
    assert got == {f"Turn:{c}:0": n - 1 for c, n in turns.items() if n > 1}


@pytest.mark.parametrize("name", ["chain_3", "cycle_close", "named_path", "shortest_path"])
def test_customers_of_any_id_are_matched(spark, sf, name):
    known = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey >= 50").count()
    got = QUERIES[name](spark, sf)
    key = {"chain_3": "c >= 50", "cycle_close": "c >= 50", "named_path": "int(regexp_extract(p, 'Customer:([0-9]+)', 1)) >= 50", "shortest_path": "int(substring(src, 10)) >= 50"}[name]
    seen = got.where(key).count()
    assert 0 < seen <= known and (seen == known or name in ("chain_3", "cycle_close"))
