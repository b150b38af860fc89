"""Named graphs whose results follow from definitions, and random ones against brute force."""

import random
from collections import deque
from itertools import combinations
from math import comb

import pytest

from trellis.operators import analytics as A
from trellis.operators import paths, traversal


def edges(spark, pairs):
    return spark.createDataFrame([(a, "E", b) for a, b in pairs], "s string, p string, o_id string")


def ordered(n, name="n"):
    return [(f"{name}{i}", f"{name}{j}") for i in range(n) for j in range(n) if i != j]


def table(df, key="id", value=None):
    value = value or [c for c in df.columns if c != key][-1]
    return {r[key]: r[value] for r in df.collect()}


def two_way(pairs):
    return pairs + [(b, a) for a, b in pairs]


def test_complete_graph(spark):
    g = edges(spark, ordered(5))
    rows = A.triangles(g).collect()
    assert {(r.triangles, r.lcc) for r in rows} == {(comb(4, 2), 1.0)}
    assert set(table(A.k_core(g), value="coreness").values()) == {4}


def test_star_has_no_triangles(spark):
    g = edges(spark, two_way([("hub", f"leaf{i}") for i in range(6)]))
    assert {(r.triangles, r.lcc) for r in A.triangles(g).collect()} == {(0, 0.0)}
    score = table(A.betweenness(g))
    assert score["hub"] == max(score.values()) == 30


def test_cycle_is_one_strong_component_and_a_chain_is_none(spark):
    cycle, chain = [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)], [("a", "b"), ("b", "c")]
    got = table(A.strong_components(edges(spark, cycle + chain + [("c", "c0")])), value="component")
    assert {got[f"c{i}"] for i in range(5)} == {"c0"} and [got[x] for x in "abc"] == ["a", "b", "c"]
    score = table(A.eigenvector(edges(spark, cycle)), value="score")
    assert max(score.values()) - min(score.values()) < 1e-6


def test_path_has_coreness_one(spark):
    assert set(table(A.k_core(edges(spark, two_way([(f"p{i}", f"p{i + 1}") for i in range(4)]))), value="coreness").values()) == {1}


def test_three_cliques(spark):
    g = edges(spark, ordered(5, "a") + ordered(4, "b") + ordered(3, "c"))
    assert len(set(table(A.components(g)).values())) == 3
    assert len(set(table(A.communities(g), value="community").values())) == 3
    assert all(v > 0 for v in table(A.closeness(g)).values())
    assert set(table(A.closeness(g, formula="classical")).values()) == {0.0}


def test_personalized_pagerank_both_ways(spark):
    g = edges(spark, [("A", "B"), ("B", "C"), ("D", "B")])
    assert {k for k, v in table(A.personalized_pagerank(g, ["B"], bidirectional=True), value="score").items() if v > 0} >= {"A", "C", "D"}


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(42)
    return [(f"r{i:02d}", f"r{j:02d}") for i in range(40) for j in range(40) if i != j and rng.random() < 0.06]


def distances(pairs, source):
    out, queue = {source: 0}, deque([source])
    while queue:
        v = queue.popleft()
        for a, b in pairs:
            if a == v and b not in out:
                out[b] = out[v] + 1
                queue.append(b)
    return out


def test_random_graph_distances_and_strong_components(spark, drawn):
    g = edges(spark, drawn)
    nodes = sorted({x for p in drawn for x in p})
    far = {v: distances(drawn, v) for v in nodes}
    got = traversal.reach(g.select("s", "o_id"), spark.createDataFrame([("r00",)], "src string"), 1, 30)
    # hops of a node first met again from itself do not concern distances
    assert {r.node: r.hop for r in got.collect() if r.node != "r00"} == {k: v for k, v in far["r00"].items() if v}
    want = {v: min(u for u in nodes if u in far[v] and v in far[u]) for v in nodes}
    assert table(A.strong_components(g), value="component") == want


def test_random_graph_triangles(spark, drawn):
    link = {frozenset(p) for p in drawn}
    want = dict.fromkeys({x for p in drawn for x in p}, 0)
    for t in combinations(sorted(want), 3):
        if all(frozenset(x) in link for x in combinations(t, 2)):
            for v in t:
                want[v] += 1
    assert table(A.triangles(edges(spark, drawn)), value="triangles") == want


def test_shortest_path_lengths(spark, drawn):
    pairs = spark.createDataFrame([("r00", f"r{i:02d}") for i in (3, 9, 17, 25)], "src string, dst string")
    far = distances(drawn, "r00")
    got = {r.dst: len(r.nodes) - 1 for r in paths.shortest(edges(spark, drawn), pairs, 6).collect()}
    assert got == {d: far[d] for d in ("r03", "r09", "r17", "r25") if d in far and far[d] <= 6}
