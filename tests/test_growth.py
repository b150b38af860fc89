"""What a task, a shuffle or the driver holds does not grow faster than the tables."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trellis import storage
from trellis.operators import analytics as A
from trellis.operators import paths
from trellis.storage import Scratch


def edges(spark, pairs):
    return spark.createDataFrame([(a, "E", b, 1.0) for a, b in pairs], "s string, p string, o_id string, weight double")


@pytest.fixture()
def written(monkeypatch):
    """Names and schemas of the tables that operators write, with their rows."""
    made, table = [], Scratch.table

    def keep(self, df, name="t"):
        out = table(self, df, name)
        made.append((name, dict(out.dtypes), out))
        return out

    monkeypatch.setattr(Scratch, "table", keep)
    return made


def test_betweenness_walks_by_numbers(spark, written):
    got = {r.id: r.score for r in A.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("b", "d")])).collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 0.0, "d": 0.0}
    assert {kind for name, types, _ in written if name in ("edges", "level", "share") for kind in types.values()} <= {"bigint", "double"}


def test_shuffles_are_dealt_out_by_the_bytes_read(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "DEALT_BYTES", 1 << 10)
    df, before = storage.read_table(spark, sf, "lineitem"), spark.conf.get("spark.sql.shuffle.partitions")
    with storage.many_parts(df):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 10 * int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_counted_matches_are_summed_not_made(spark, written):

    from trellis.plans.graph import EdgeTable, Graph

    n, ident = 20_000, lambda kind: F.concat(F.lit(kind), "id")
    g = Graph(spark, edges={k: EdgeTable(spark.range(n).select(ident(k).alias("s"), F.concat(F.lit("n"), F.col("id") % 2).alias("o_id"))) for k in "AB"})
    assert g.cypher("MATCH (a)-[:A]->(n)<-[:B]-(b) RETURN n.id AS n, count(*) AS k ORDER BY n").collect() == [("n0", n * n // 4), ("n1", n * n // 4)]
    assert max(df.count() for _, _, df in written) <= n
    assert g.cypher("MATCH (a)-[:A]->(n)<-[:B]-(b) RETURN count(b) AS k").first().k == n * n // 2
    assert g.cypher("MATCH (a {id: 'none'})-[:A]->(n)<-[:B]-(b) RETURN count(*) AS k").first().k == 0


def test_counted_cycle(spark, written):
    from trellis.plans.graph import EdgeTable, Graph

    one = lambda a, b: EdgeTable(spark.range(600).select(F.concat(F.lit(a), F.col("id") % 20).alias("s"), F.concat(F.lit(b), F.col("id") % 30).alias("o_id")))
    g = Graph(spark, edges={"X": one("c", "n"), "Y": one("s", "n"), "Z": one("c", "s")})
    got = {r.c: r.k for r in g.cypher("MATCH (c)-[:X]->(n)<-[:Y]-(s)<-[:Z]-(c) RETURN c.id AS c, count(*) AS k").collect()}
    x = lambda a, b: [(f"{a}{i % 20}", f"{b}{i % 30}") for i in range(600)]
    want = Counter()
    xs, ys, zs = Counter(x("c", "n")), Counter(x("s", "n")), Counter(x("c", "s"))
    for (c, v), i in xs.items():
        for (u, w), j in ys.items():
            if w == v:
                want[c] += i * j * zs[c, u]
    assert got == {c: k for c, k in want.items() if k} and any("summed" in name for name, *_ in written)


def test_shortest_paths_do_not_meet_other_sources_edges(spark, monkeypatch):
    """What a hub's edges are joined with has the source as a key too."""
    n, plans, table = 3000, [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(self, df, name))
    g = spark.range(n).select(F.concat(F.lit("leaf"), "id").alias("s"), F.lit("E").alias("p"), F.lit("hub").alias("o_id")).unionAll(spark.createDataFrame([("hub", "E", "end")], "s string, p string, o_id string"))
    rows = paths.shortest(g, g.where("s <> 'hub'").select(F.col("s").alias("src"), F.lit("end").alias("dst")), 4).collect()
    assert len(rows) == n and all(r.nodes == [r.src, "hub", "end"] and r.rels == ["E", "E"] for r in rows)
    back = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line and "at#" in line]
    assert back and all("src#" in line for line in back)


def test_stream_buckets_keep_no_running_result(spark, tmp_path, written):
    from trellis.streaming import buckets

    for i in range(6):  # the last file is days late
        spark.range(50).select(F.timestamp_seconds(F.lit(1_700_000_000 - 500_000 * (i == 5)) + i * 300).alias("at"), F.concat(F.lit("u"), "id").alias("s"), F.lit("x").alias("p"), F.lit(1.5).alias("w")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    stream = buckets.read(spark, f"{tmp_path}/e", schema, 1)
    got = buckets.buckets_available(stream).collect()
    assert len(got) == 300 and {(r.n, r.sum, r.min, r.max) for r in got} == {(1, 1.5, 1.5, 1.5)}
    assert any(df.inputFiles() for *_, df in written) and buckets.buckets_available(buckets.read(spark, f"{tmp_path}/e", schema, 1).where("s = 'no'")).count() == 0


@pytest.mark.parametrize("bits", [0, 1 << 29])
def test_triangles_of_many_groups_make_no_wedges(spark, written, monkeypatch, bits):
    monkeypatch.setattr(A, "TASK_EDGES", 60)
    monkeypatch.setattr(A, "TASK_BITS", bits)
    rng = random.Random(7)
    link = {(i, j) for i in range(60) for j in range(i) if rng.random() < 0.2} | {(i, 0) for i in range(1, 60)}
    want = Counter(x for i, j, k in combinations(range(59, -1, -1), 3) if {(i, j), (j, k), (i, k)} <= link for x in (i, j, k))
    got = {int(r.id): r.triangles for r in A.triangles(edges(spark, [(str(a), str(b)) for a, b in link])).collect()}
    assert got == {i: want[i] for i in range(60)}
    assert "blocks" in {name for name, *_ in written} and max(df.count() for _, _, df in written) <= 2 * len(link)


def test_communities_of_components_are_found_in_tasks(spark, monkeypatch):
    """More edges in all than one task may hold; a component that is too large is refused."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i in range(8) for j in range(i)] + [("z0", "z1")]
    monkeypatch.setattr(A, "MOST_EDGES", 30)
    rows = A.communities(edges(spark, pairs)).collect()
    assert {r.id: (r.community, r.size) for r in rows} == {f"{c}{i}": (k, 8) for k, c in enumerate("abcdef") for i in range(8)} | {"z0": (6, 2), "z1": (6, 2)}
    monkeypatch.setattr(A, "MOST_EDGES", 20)
    with pytest.raises(ValueError):
        A.communities(edges(spark, pairs))


def test_numbers_stand_for_ids_in_loops(spark, written):
    g = edges(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("x", "y"), ("z", "z"), ("c", "x")])
    assert {r.id: r.component for r in A.components(g).collect()} == dict.fromkeys("abcxy", "a") | {"z": "z"}
    assert {r.id: r.component for r in A.strong_components(g).collect()} == dict.fromkeys("abc", "a") | {c: c for c in "xyz"}
    assert {r.id: r.coreness for r in A.k_core(g).collect()} == dict.fromkeys("abc", 2) | dict.fromkeys("xy", 1)
    assert {r.id: r.label for r in A.label_propagation(g, 1).collect()} == {"a": "b", "b": "a", "c": "a", "x": "c", "y": "x", "z": "z"}
    looped = [types for name, types, _ in written if name in ("both", "up", "far", "label", "value", "left", "live", "c", "same")]
    assert len(looped) > 10 and not any(kind == "string" for types in looped for kind in types.values())


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    from trellis.operators import search

    plans, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t": plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, name))
    texts = [(1, "B a b  a b!"), (2, "... "), (3, None), (4, "c"), (5, "")]
    one = search.BM25(spark.createDataFrame(texts, "id int, text string"))
    assert {(r.id, r.len, r.term, r.tf) for r in one.postings.collect()} == {(1, 5, "a", 2), (1, 5, "b", 3), (4, 1, "c", 1)}
    assert (one.n, one.mean) == (2, 3.0) and "Exchange" not in plans[0]
    twice = search.BM25(spark.createDataFrame([*texts, (1, "a a a a a"), (1, "a")], "id int, text string"))
    assert {(r.id, r.len, r.term, r.tf) for r in twice.postings.collect()} == {(1, 5, "a", 7), (1, 5, "b", 3), (1, 1, "a", 1), (4, 1, "c", 1)} and twice.n == 2


def test_edges_take_the_scores_of_their_vectors(spark):
    from trellis.operators import search

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, embedding array<float>")
    e = spark.createDataFrame([("a", "E", "b", 1), ("a", "E", "c", 2), ("d", "E", "e", 3), ("f", "E", "g", 1)], "s string, p string, o_id string, id int")
    assert search.edge_knn_by(e, v, [1.0, 0.0], 3).collect() == [("a", "E", "b", 1.0), ("f", "E", "g", 1.0), ("a", "E", "c", 0.0)] == search.edge_knn(e.join(v, "id"), [1.0, 0.0], 3).collect()


def test_personalised_rank_has_rows_near_its_seeds_alone(spark, written):
    far = [(f"far{i}", f"far{i + 1}") for i in range(500)]
    g = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), *far])
    got = {r.id: round(r.score, 9) for r in A.personalized_pagerank(g, ["a", "nowhere"], rounds=2, tolerance=1e-12).collect()}
    x = 0.5, 0.0, 0.0
    for _ in range(2):
        x = 0.075 + 0.85 * x[1] / 2, 0.85 * x[0], 0.85 * x[1] / 2
    assert got == {k: round(v, 9) for k, v in zip("abc", x, strict=True) if v}
    assert max(df.count() for name, _, df in written if name == "rank") <= 3


def test_rings_make_no_wedges(spark, written, monkeypatch):
    monkeypatch.setattr(A, "TASK_EDGES", 40)
    rng = random.Random(3)
    link = {(i, j) for i in range(40) for j in range(40) if i != j and rng.random() < 0.06}
    want = {str(x) for i, j in link for k in range(40) if (j, k) in link and (k, i) in link for x in (i, j, k)}
    assert {r.id for r in A.rings(edges(spark, [(str(a), str(b)) for a, b in link])).collect()} == want and 0 < len(want) < 40
    assert max(df.count() for _, _, df in written) <= 2 * len(link)
