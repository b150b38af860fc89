"""Graph analytics over edges(s, p, o_id, weight); results have `id` and a score.

Loops are bounded rounds of joins; each round is written to the shared folder. What walks from sources (closeness,
betweenness) runs for all of them at once, as joins keyed by source. Loops go by numbers in place of ids.
"""

from __future__ import annotations

import sys
from collections import defaultdict, deque
from functools import reduce
from math import ceil, sqrt
from typing import TYPE_CHECKING

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.traversal import reach
from trellis.storage import Scratch

if TYPE_CHECKING:
    from collections.abc import Callable

    import pandas as pd

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: edges that a task of `communities` may hold
MOST_EDGES = 2_000_000


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("s", "o_id").distinct()


def _nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Ends of edges, and nodes(id) that may have none."""
    ends = edges.select(F.col("s").alias("id")).union(edges.select("o_id"))
    return (ends if nodes is None else ends.union(nodes.select("id"))).distinct()


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) without loops."""
    return edges.where("s <> o_id").select(F.least("s", "o_id").alias("a"), F.greatest("s", "o_id").alias("b")).distinct()


def _both(simple: DataFrame) -> DataFrame:
    return simple.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(simple.select("b", "a"))


def _coded(scratch: Scratch, edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges(s, o_id) by numbers that take the place of ids, and named(n, id, rank): ranks are numbers in the order of ids.

    A number is a hash of the id. Should two ids have one number, which is looked for, all are hashed with another salt."""
    ids = scratch.table(_nodes(edges, nodes).where("id IS NOT NULL"), "ids")
    for salt in range(100):
        number = lambda c: F.xxhash64(c, F.lit(salt))  # noqa: B023, E731
        named = scratch.table(ids.orderBy("id").select(number("id").alias("n"), "id", F.monotonically_increasing_id().alias("rank")), "named")
        if named.count() == named.select("n").distinct().count():
            break
    else:
        raise ValueError("no salt gives each id a number of its own")
    return edges.where("s IS NOT NULL AND o_id IS NOT NULL").select(number("s").alias("s"), number("o_id").alias("o_id")), named


def degree_centrality(edges: DataFrame, direction: str = "both", predicate: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    e = edges if predicate is None else edges.where(F.col("p") == predicate)
    ends = {"out": e.select(F.col("s").alias("id")), "in": e.select(F.col("o_id").alias("id")), "both": e.select(F.col("s").alias("id")).unionAll(e.select("o_id"))}[direction]
    all_ = _nodes(e, nodes)
    n = all_.agg(F.count("*").alias("nodes"))
    degree = all_.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return degree.join(F.broadcast(n)).select("id", (F.col("degree") / F.greatest(F.lit(1), F.col("nodes") - 1)).alias("score"), "degree")


def _ranked(edges: DataFrame, start: DataFrame, teleport, damping: float, rounds: int, tolerance: float | None, universe: DataFrame | None) -> DataFrame:
    """Without a universe, nodes of rank 0 have no rows, so that rounds near few nodes are small."""
    scratch = Scratch(edges.sparkSession, "rank")
    out = edges.groupBy("s").agg(F.sum("weight").alias("total"))
    step = scratch.table(edges.join(out, "s").select("s", "o_id", (F.col("weight") / F.col("total")).alias("share")), "steps")
    rank = scratch.table(start, "rank")
    for _ in range(rounds):
        got = step.join(rank, F.col("s") == F.col("id")).groupBy(F.col("o_id").alias("id")).agg(F.sum(F.col("share") * F.col("score")).alias("inflow"))
        met = got.join(teleport, "id", "full") if universe is None else universe.join(got, "id", "left").join(teleport, "id", "left")
        new = met.select("id", (F.coalesce("teleport", F.lit(0.0)) + damping * F.coalesce("inflow", F.lit(0.0))).alias("score"))
        if tolerance is None:
            rank = scratch.table(new, "rank")
            continue
        old = rank.withColumnRenamed("score", "old")
        both = new.join(old, "id", "left" if universe is not None else "full")
        new = scratch.table(both.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("old", F.lit(0.0)).alias("old")), "rank")
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        rank = new.select("id", "score")
        if moved is None or moved < tolerance:
            break
    return rank


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """id, score: teleport (1-d)/n to all nodes, shares by edge, what sinks hold is not passed on."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    e = scratch.table(_pairs(edges).withColumn("weight", F.lit(1.0)), "edges")
    nodes = scratch.table(_nodes(e, nodes), "nodes")
    n = max(1, nodes.count())
    return _ranked(e, nodes.withColumn("score", F.lit(1.0 / n)), nodes.withColumn("teleport", F.lit((1 - damping) / n)), damping, rounds, tolerance, nodes)


def personalized_pagerank(edges: DataFrame, seeds: list[str], damping: float = 0.85, rounds: int = 20, tolerance: float | None = 1e-6, bidirectional: bool = False, reverse_weight: float = 1.0) -> DataFrame:
    """id, score > 0: teleport (1-d)/|seeds| to seeds; reverse edges with a weight of their own if bidirectional."""
    scratch = Scratch(edges.sparkSession, "ppr")
    e = scratch.table(_pairs(edges), "pairs").withColumn("weight", F.lit(1.0))
    if bidirectional:
        e = e.unionAll(e.select("o_id", "s", F.lit(float(reverse_weight))))
    # only rows of seeds, so that their nodes are not those of all edges
    at = scratch.table(_nodes(e.where(F.col("s").isin(*seeds) | F.col("o_id").isin(*seeds))).where(F.col("id").isin(*seeds)), "seeds")
    k = max(1, len(set(seeds)))
    out = _ranked(e, at.withColumn("score", F.lit(1.0 / k)), at.withColumn("teleport", F.lit((1 - damping) / k)), damping, rounds, tolerance, None)
    return out.where("score > 0")


def eigenvector(edges: DataFrame, rounds: int = 30, tolerance: float | None = None) -> DataFrame:
    """id, score: power iteration along out edges with length 1, from 1/n."""
    scratch = Scratch(edges.sparkSession, "eigen")
    e, nodes = scratch.table(_pairs(edges), "edges"), scratch.table(_nodes(edges), "nodes")
    x = nodes.withColumn("score", F.lit(1.0 / max(1, nodes.count())))
    for _ in range(rounds):
        got = e.join(x, F.col("s") == F.col("id")).groupBy(F.col("o_id").alias("id")).agg(F.sum("score").alias("y"))
        got = scratch.table(nodes.join(got, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y")), "y")
        norm = got.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if not norm:
            return nodes.withColumn("score", F.lit(0.0))
        new = got.select("id", (F.col("y") / norm).alias("score"))
        if tolerance is not None and new.join(x.withColumnRenamed("score", "old"), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] < tolerance:
            return new
        x = new
    return x


def _roots(scratch: Scratch, e: DataFrame) -> DataFrame | None:
    """n, root: the least number of the component, of nodes of edges(s, o_id) by numbers; None if no edge joins two.

    Each node is hung below its least neighbour, if that is less; what hangs below one root becomes one node, and so on.
    A node that is left has taken in another one, so there are at most as many rounds as halvings."""
    e, of = e.where("s <> o_id"), None
    while not e.isEmpty():
        both = e.unionAll(e.select("o_id", "s"))
        up = scratch.table(both.groupBy(F.col("s").alias("n")).agg(F.min("o_id").alias("root")).select("n", F.least("n", "root").alias("root")), "up")
        while True:
            far = scratch.table(up.join(up.toDF("root", "top"), "root").select("n", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "far")
            up = far.select("n", "root")
            if far.where("moved").isEmpty():
                break
        of = up if of is None else scratch.table(of.join(up.toDF("root", "top"), "root", "left").select("n", F.coalesce("top", "root").alias("root")), "of")
        e = e.join(up.toDF("s", "a"), "s").join(up.toDF("o_id", "b"), "o_id").where("a <> b").select(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("o_id"))
        e = scratch.table(e.distinct(), "between")
    return of


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component: the least id that is connected. Nodes(id) without an edge are components of their own."""
    scratch = Scratch(edges.sparkSession, "wcc")
    e, named = _coded(scratch, scratch.table(_pairs(edges), "pairs"), nodes)
    of = _roots(scratch, scratch.table(e, "edges"))
    if of is None:
        return named.select("id", F.col("id").alias("component"))
    rooted = scratch.table(named.join(of, "n", "left").select("id", F.coalesce("root", "n").alias("root")), "rooted")
    return scratch.table(rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"), "components")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, label: the commonest label of neighbours in both directions, parallel edges counted, ties to the least."""
    scratch = Scratch(edges.sparkSession, "cdlp")
    e, named = _coded(scratch, scratch.table(edges.select("s", "o_id"), "pairs"))
    both = scratch.table(e.toDF("u", "v").unionAll(e.select("o_id", "s")), "both")
    label = named.select("n", F.col("rank").alias("label"))
    for _ in range(rounds):
        votes = both.join(label, F.col("v") == F.col("n")).groupBy(F.col("u").alias("n"), "label").agg(F.count("*").alias("k"))
        label = scratch.table(votes.groupBy("n").agg(F.min(F.struct(-F.col("k"), "label"))["label"].alias("label")), "label")
    return scratch.table(label.join(named.select("n", "id"), "n").join(named.select(F.col("rank").alias("label"), F.col("id").alias("of")), "label").select("id", F.col("of").alias("label")), "labels")


#: edges that a task of `triangles` may hold, and bits of the table in which it looks edges up
TASK_EDGES, TASK_BITS = 2_000_000, 1 << 29


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles, lcc over undirected simple edges.

    Nodes are dealt out to k groups. Edges between two groups are packed into one row, and each three groups, which may be
    the same, are one task that has the edges between these alone; k grows with the root of the edges, so that a task's
    edges stay as many, and an edge goes to k tasks. Pairs of a node's neighbours are made within tasks only."""
    scratch = Scratch(edges.sparkSession, "triangles")
    e, named = _coded(scratch, scratch.table(_simple(edges).toDF("s", "o_id"), "edges"))
    e = scratch.table(e.select(F.least("s", "o_id").alias("a"), F.greatest("s", "o_id").alias("b")), "coded")
    found = _threes(scratch, e.withColumn("way", F.lit(3)), False)
    degree = e.select(F.col("a").alias("n")).unionAll(e.select("b")).groupBy("n").agg(F.count("*").alias("k"))
    out = named.join(degree, "n").join(found.groupBy("n").agg(F.sum("triangles").alias("triangles")), "n", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return scratch.table(out.select("id", "triangles", F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("lcc")), "out")


def rings(edges: DataFrame) -> DataFrame:
    """id of nodes on directed cycles of three edges, found as `triangles` are."""
    scratch = Scratch(edges.sparkSession, "rings")
    e, named = _coded(scratch, scratch.table(_pairs(edges).where("s <> o_id"), "edges"))
    way = F.when(F.col("s") < F.col("o_id"), 1).otherwise(2)
    e = scratch.table(e.groupBy(F.least("s", "o_id").alias("a"), F.greatest("s", "o_id").alias("b")).agg(F.bit_or(way).alias("way")), "coded")
    return scratch.table(named.join(_threes(scratch, e, True).select("n").distinct(), "n", "left_semi").select("id"), "out")


def _threes(scratch: Scratch, e: DataFrame, ring: bool) -> DataFrame:
    """n, triangles of edges(a, b, way), a node once for each task that it has some in. Of way, 1 leads from a to b and 2
    back; if `ring`, only triangles that can be gone around count."""
    k = max(4, ceil(sqrt(6 * e.count() / TASK_EDGES)))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    back = F.when(F.col("way") == 3, 3).otherwise(3 - F.col("way"))
    dealt = e.select(F.when(group("a") <= group("b"), F.struct("a", "b", "way")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), back.alias("way"))).alias("x")).select("x.*")
    blocks = scratch.table(dealt.select(group("a").alias("i"), group("b").alias("j"), "a", "b", "way").groupBy("i", "j").applyInPandas(_packed(), "i int, j int, heads binary, tails binary, a binary, b binary, way binary"), "blocks")
    three = F.sort_array(F.array("i", "j", "l"))
    tasks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("l")).withColumn("three", three)
    return scratch.table(tasks.groupBy("three").applyInPandas(_closed(ring), "n long, triangles long"), "found")


def _packed() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The edges of two groups as one row: the nodes of each side, and places among these."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        heads, a = np.unique(rows.a.to_numpy(), return_inverse=True)
        tails, b = np.unique(rows.b.to_numpy(), return_inverse=True)
        small = [x.astype(np.uint16 if len(of) <= 1 << 16 else np.uint32).tobytes() for x, of in ((a, heads), (b, tails))]
        return pd.DataFrame({"i": [rows.i.iloc[0]], "j": [rows.j.iloc[0]], "heads": [heads.tobytes()], "tails": [tails.tobytes()], "a": [small[0]], "b": [small[1]], "way": [rows.way.to_numpy().astype(np.uint8).tobytes()]})

    return run


def _closed(ring: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """n, triangles of nodes among the edges of three groups, triangles of one group only where all three are the same."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        ends, groups, ways = [], [], []
        for r in blocks.drop_duplicates(["i", "j"]).itertuples():
            ways.append(np.frombuffer(r.way, np.uint8))
            for side, at, g in ((r.heads, r.a, r.i), (r.tails, r.b, r.j)):
                of = np.frombuffer(side, np.int64)
                ends.append(of[np.frombuffer(at, np.uint16 if len(of) <= 1 << 16 else np.uint32)])
                groups.append(np.full(len(ends[-1]), g, np.int32))
        ids, first, place = np.unique(np.concatenate(ends), return_index=True, return_inverse=True)
        group, size = np.concatenate(groups)[first], len(ids)
        cut = np.cumsum([0, *map(len, ends)])
        a, b = (np.concatenate([place[cut[i] : cut[i + 1]] for i in range(x, len(ends), 2)]) for x in (0, 1))
        # nodes are numbered by degree, and each edge leads from the lesser one, so that hubs' neighbours are few
        order = np.argsort(np.bincount(np.concatenate([a, b]), minlength=size), kind="stable")
        number = np.empty(size, np.int64)
        number[order] = np.arange(size)
        a, b, group = number[a], number[b], group[order]
        key = np.minimum(a, b) * size + np.maximum(a, b)
        by, way = np.argsort(key), np.concatenate(ways)
        way = np.where((a < b) | (way == 3), way, 3 - way)[by]
        key = key[by]
        x, y = (key // size).astype(np.int32), (key % size).astype(np.int32)
        if size * size <= TASK_BITS:
            bits = np.zeros(size * size // 8 + 1, np.uint8)
            np.bitwise_or.at(bits, key >> 3, np.left_shift(1, key & 7).astype(np.uint8))
            has = lambda k: (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
        else:
            has = lambda k: key[np.minimum(np.searchsorted(key, k), len(key) - 1)] == k
        left = np.searchsorted(x, x, side="right") - np.arange(len(x)) - 1  # neighbours that follow in the list of the same node
        upto, met = np.concatenate([[0], np.cumsum(left)]), np.zeros(size, np.int64)
        mixed, lo = len(set(blocks.three.iloc[0])) > 1, 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 21), side="right")) - 1)
            one = np.repeat(np.arange(lo, hi), left[lo:hi])
            two = np.arange(upto[hi] - upto[lo]) - (upto[one] - upto[lo]) + one + 1
            hit = has(y[one].astype(np.int64) * size + y[two])
            one, two = one[hit], two[hit]
            if mixed:
                apart = ~((group[x[one]] == group[y[one]]) & (group[y[one]] == group[y[two]]))
                one, two = one[apart], two[apart]
            if ring:
                last = way[np.searchsorted(key, y[one].astype(np.int64) * size + y[two])]
                round_ = ((way[one] & last & 1) & (way[two] >> 1)) | ((way[two] & 1) & (last >> 1) & (way[one] >> 1))
                one, two = one[round_ == 1], two[round_ == 1]
            for n in (x[one], y[one], y[two]):
                met += np.bincount(n, minlength=size)
            lo = hi
        some = met > 0
        return pd.DataFrame({"n": ids[order][some], "triangles": met[some]})

    return run


def k_core(edges: DataFrame) -> DataFrame:
    """id, coreness: the h-index of neighbours' values, repeated until nothing moves."""
    scratch = Scratch(edges.sparkSession, "kcore")
    e, named = _coded(scratch, scratch.table(_simple(edges).toDF("s", "o_id"), "edges"))
    both = scratch.table(_both(e.toDF("a", "b")), "both")
    value = scratch.table(both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("coreness")), "value")
    while True:
        near = both.join(value, F.col("v") == F.col("id")).groupBy(F.col("u").alias("id"), "coreness").agg(F.count("*").alias("n"))
        # the h-index from counts of values: the largest h with h neighbours of value h and more
        listed = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("coreness", "n")), asc=False).alias("l"))
        zero = F.lit(0).cast("long")
        h = F.aggregate("l", F.struct(zero.alias("sum"), zero.alias("h")), lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.greatest(a["h"], F.least(x["coreness"], a["sum"] + x["n"])).alias("h")), lambda a: a["h"])
        new = scratch.table(listed.select("id", h.alias("h")).join(value, "id").select("id", F.least("h", "coreness").alias("coreness"), F.col("coreness").alias("old")), "value")
        value = new.select("id", "coreness")
        if new.where("old <> coreness").isEmpty():
            return scratch.table(value.join(named.toDF("id", "name", "rank"), "id").select(F.col("name").alias("id"), "coreness"), "coreness")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id): nodes that lack edges in or out are taken off first, being alone; then colour by the
    least id that reaches a node, and take what the colour's root is reached from within the colour; the rest goes on."""
    scratch = Scratch(edges.sparkSession, "scc")
    e, named = _coded(scratch, scratch.table(_pairs(edges), "pairs"))
    left, done = scratch.table(named.select(F.col("n").alias("id")), "left"), None
    live = scratch.table(e.where("s <> o_id"), "live")
    while not left.isEmpty():
        inner = scratch.table(live.select(F.col("s").alias("id")).intersect(live.select("o_id")), "inner")
        alone = scratch.table(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")), "alone")
        if not alone.isEmpty():
            done = alone if done is None else done.unionAll(alone)
            left = inner
            live = scratch.table(live.join(left.toDF("s"), "s", "left_semi").join(left.toDF("o_id"), "o_id", "left_semi"), "live")
            continue
        colour = _spread(scratch, live, left.withColumn("c", F.col("id")))
        same = live.join(colour.toDF("s", "cs"), "s").join(colour.toDF("o_id", "co"), "o_id").where("cs = co").select("s", "o_id")
        same = scratch.table(same, "same")
        roots = colour.where("id = c").select(F.col("id").alias("src"))
        back = reach(same.select(F.col("o_id").alias("s"), F.col("s").alias("o_id")), roots, 0, 1_000_000)
        found = scratch.table(back.select(F.col("node").alias("id"), F.col("src").alias("component")), "found")
        done = found if done is None else done.unionAll(found)
        left = scratch.table(left.join(found, "id", "left_anti"), "left")
        live = scratch.table(live.join(left.toDF("s"), "s", "left_semi").join(left.toDF("o_id"), "o_id", "left_semi"), "live")
    if done is None:
        return named.select("id", F.col("id").alias("component"))
    done = scratch.table(done.join(named.select(F.col("n").alias("id"), F.col("id").alias("name")), "id").select("name", "component"), "done")
    return scratch.table(done.join(done.groupBy("component").agg(F.min("name").alias("least")), "component").select(F.col("name").alias("id"), F.col("least").alias("component")), "components")


def _spread(scratch: Scratch, edges: DataFrame, value: DataFrame) -> DataFrame:
    value = scratch.table(value, "c")
    while True:
        near = edges.join(value, F.col("s") == F.col("id")).groupBy(F.col("o_id").alias("id")).agg(F.min("c").alias("near"))
        new = scratch.table(value.join(near, "id", "left").select("id", F.least("c", "near").alias("c"), F.col("c").alias("old")), "c")
        value = new.select("id", "c")
        if new.where("old <> c").isEmpty():
            return value


def closeness(edges: DataFrame, formula: str = "harmonic", direction: str = "out", hops: int = 10, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """id, score of sources(src), or of all nodes: harmonic sum(1/d), over n-1 if normalized; classical (n-1)/sum(d), 0
    if some node is not reached."""
    nodes = Scratch(edges.sparkSession, "closeness").table(_nodes(edges), "nodes")
    n = max(2, nodes.count())
    seeds = nodes.select(F.col("id").alias("src")) if sources is None else sources
    got = reach(edges, seeds, 1, hops, direction).groupBy(F.col("src").alias("id")).agg(F.sum(1 / F.col("hop")).alias("h"), F.sum("hop").alias("d"), F.count("*").alias("k"))
    score = F.col("h") / (n - 1 if normalized else 1) if formula == "harmonic" else F.when(F.col("k") == n - 1, (n - 1) / F.col("d")).otherwise(0.0)
    return seeds.select(F.col("src").alias("id")).join(got, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def closeness_estimated(edges: DataFrame, direction: str = "out", hops: int = 10, registers: int = 64, normalized: bool = True) -> DataFrame:
    """id, score: harmonic closeness of all nodes, from sketches of how many nodes lie within each hop. A node's sketch has
    `registers` greatest ranks, as rows of their own, so that nothing grows with the number of nodes reached; the error of
    a count is about 1.04 / sqrt(registers). Neighbours' sketches are merged once a hop, until none changes."""
    from trellis.operators.traversal import oriented

    scratch = Scratch(edges.sparkSession, "closeness-estimated")
    step = scratch.table(oriented(edges, direction).where("s <> o_id"), "edges")
    nodes = scratch.table(_nodes(edges), "nodes")
    n, h = max(2, nodes.count()), F.xxhash64("id")
    rank = F.least(F.lit(50), 1 + F.length(F.bin(F.shiftrightunsigned(h, 8))).cast("int") * -1 + 56)  # zeros that lead 56 bits
    sketch = scratch.table(nodes.select("id", F.pmod(h, F.lit(registers)).alias("r"), rank.alias("v")), "sketch")
    alpha = 0.7213 / (1 + 1.079 / registers)

    def counted(of: DataFrame) -> DataFrame:
        of = of.groupBy("id").agg(F.sum(F.pow(F.lit(2.0), -F.col("v"))).alias("z"), F.count("*").alias("k"))
        raw = alpha * registers**2 / (F.col("z") + (registers - F.col("k")))
        few = registers * F.log(registers / (registers - F.col("k")))
        return of.select("id", F.when((raw <= 2.5 * registers) & (F.col("k") < registers), few).otherwise(raw).alias("within"))

    before = scratch.table(counted(sketch).withColumn("score", F.lit(0.0)), "within")
    for hop in range(1, hops + 1):
        came = step.join(sketch.withColumnRenamed("id", "o_id"), "o_id").select(F.col("s").alias("id"), "r", "v")
        grown = scratch.table(sketch.unionAll(came).groupBy("id", "r").agg(F.max("v").alias("v")), "sketch")
        if grown.join(sketch, ["id", "r", "v"], "left_anti").isEmpty():
            break
        sketch = grown
        more = F.greatest(F.lit(0.0), F.col("now.within") - F.col("was.within")) / hop
        before = scratch.table(counted(sketch).alias("now").join(before.alias("was"), "id").select("id", "now.within", (F.col("score") + more).alias("score")), "within")
    return before.select("id", (F.col("score") / (n - 1 if normalized else 1)).alias("score"))


def betweenness(edges: DataFrame, sample: int | None = None, direction: str = "out") -> DataFrame:
    """id, score: raw sum of dependencies, scaled by n / sample; sources are those of least hash.

    All sources go level by level at once, as joins keyed by source and node: numbers of shortest paths on the way out,
    dependencies on the way back. That is sources * nodes rows; without `sample` every node is a source."""
    scratch = Scratch(edges.sparkSession, "betweenness")
    pairs = scratch.table(_pairs(edges), "pairs")
    e, named = _coded(scratch, pairs)
    e = scratch.table(e.where("s <> o_id") if direction == "out" else _both(_simple(e)).toDF("s", "o_id"), "edges")
    n = named.count()
    chosen = named if sample is None or sample >= n else named.orderBy(F.xxhash64("id"), "id").limit(sample)
    # sources are told apart by their rank among those chosen
    levels = [scratch.table(chosen.select(F.col("rank").alias("src"), F.col("n").alias("node"), F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("src", "node")
    while True:
        met = levels[-1].join(e, F.col("node") == F.col("s")).groupBy("src", F.col("o_id").alias("node")).agg(F.sum("paths").alias("paths"))
        new = scratch.table(met.join(seen, ["src", "node"], "left_anti"), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionAll(new.select("src", "node"))
    below, parts = levels[-1].withColumn("share", F.lit(0.0)), []
    for above in levels[-2:0:-1]:  # the sources themselves get nothing
        through = below.join(e, F.col("node") == F.col("o_id")).groupBy("src", F.col("s").alias("node")).agg(F.sum((1 + F.col("share")) / F.col("paths")).alias("through"))
        below = scratch.table(above.join(through, ["src", "node"], "left").select("src", "node", "paths", F.coalesce(F.col("paths") * F.col("through"), F.lit(0.0)).alias("share")), "share")
        parts.append(below.select("node", "share"))
    if not parts:
        return named.select("id", F.lit(0.0).alias("score"))
    total = reduce(DataFrame.unionAll, parts).groupBy(F.col("node").alias("n")).agg((F.sum("share") * (n / min(n, sample or n))).alias("score"))
    return scratch.table(named.join(total, "n", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), "score")


def betweenness_neighborhood(edges: DataFrame, seed: str, hops: int = 2, sample: int | None = 200) -> DataFrame:
    near = reach(edges, edges.sparkSession.createDataFrame([(seed,)], "src string"), 0, hops, "both").select("node")
    inside = edges.join(near.toDF("s"), "s", "left_semi").join(near.toDF("o_id"), "o_id", "left_semi")
    return betweenness(inside, sample)


def modularity(adjacency: dict[str, set[str]], of: dict[str, int], gamma: float = 1.0) -> float:
    m2 = sum(map(len, adjacency.values())) or 1
    inside, degree = defaultdict(float), defaultdict(float)
    for u, vs in adjacency.items():
        degree[of[u]] += len(vs)
        inside[of[u]] += sum(of[v] == of[u] for v in vs)
    return sum(inside[c] / m2 - gamma * (degree[c] / m2) ** 2 for c in degree)


def _moves(weights: dict[int, dict[int, float]], size: dict[int, float], gamma: float, total: float, start: dict[int, int]) -> dict[int, int]:
    """Local moving from `start`: every node goes to the neighbouring community of most gain until none does."""
    of, mass = dict(start), defaultdict(float)
    for u, c in of.items():
        mass[c] += size[u]
    queue, waiting = deque(sorted(weights)), {*weights}
    while queue:
        u = queue.popleft()
        waiting.discard(u)
        to: dict[int, float] = defaultdict(float)
        for v, w in weights[u].items():
            if v != u:
                to[of[v]] += w
        mass[of[u]] -= size[u]
        gain = lambda c: to[c] - gamma * size[u] * mass[c] / total  # noqa: B023, E731
        best = max([of[u], *to], key=lambda c: (round(gain(c), 12), c == of[u], -c))
        mass[best] += size[u]
        if best != of[u]:
            of[u] = best
            for v in weights[u]:
                if of[v] != best and v not in waiting:
                    queue.append(v)
                    waiting.add(v)
    return of


def _refined(weights: dict[int, dict[int, float]], size: dict[int, float], gamma: float, total: float, of: dict[int, int]) -> dict[int, int]:
    """The refinement of Leiden: within each community nodes start alone, and one that is still alone and well tied to its
    community joins the part of it that gains most, among parts that are well tied too. So every part is connected."""
    whole: dict[int, float] = defaultdict(float)
    for u, c in of.items():
        whole[c] += size[u]
    part, mass, alone = {u: u for u in weights}, dict(size), {*weights}
    inside = {u: sum(w for v, w in vs.items() if v != u and of[v] == of[u]) for u, vs in weights.items()}
    out = dict(inside)  # ties of each part to the rest of its community
    tied = lambda p, c: out[p] >= gamma * mass[p] * (whole[c] - mass[p]) / total - 1e-12
    for u in sorted(weights):
        c = of[u]
        if u not in alone or not tied(u, c):
            continue
        to: dict[int, float] = defaultdict(float)
        for v, w in weights[u].items():
            if v != u and of[v] == c:
                to[part[v]] += w
        gains = {p: w - gamma * size[u] * mass[p] / total for p, w in to.items() if p != u and tied(p, c)}
        best = max(gains, key=lambda p: (round(gains[p], 12), -p), default=None)
        if best is None or gains[best] <= 0:
            continue
        part[u] = best
        alone -= {u, best}
        mass[best] += size[u]
        out[best] += inside[u] - 2 * to[best]
        mass.pop(u), out.pop(u)
    return part


def _connected(weights: dict[int, dict[int, float]], of: dict[int, int]) -> dict[int, int]:
    """Splits communities that are not connected inside, which the last local moving may leave."""
    out: dict[int, int] = {}
    for root in sorted(weights):
        if root in out:
            continue
        out[root], queue = root, deque([root])
        while queue:
            u = queue.popleft()
            for v in weights[u]:
                if v not in out and of[v] == of[u]:
                    out[v] = root
                    queue.append(v)
    return out


def communities(edges: DataFrame, gamma: float = 1.0, levels: int = 10) -> DataFrame:
    """id, community, size: modularity communities by Leiden: local moving, refinement, and aggregation by the refined
    parts, which start the next level in the communities that they came from. Each is connected; they are numbered from the
    largest.

    Moves depend on one another, but only within a component: of other components only the edges' number counts. So each
    component is found in a task, small ones many together, and nothing of the graph is on the driver. A component of more
    than `MOST_EDGES` edges, which a task could not hold, is refused."""
    scratch = Scratch(edges.sparkSession, "communities")
    e, named = _coded(scratch, scratch.table(_simple(edges).toDF("s", "o_id"), "pairs"))
    e = scratch.table(e, "edges")
    of = _roots(scratch, e)
    if of is None:
        return edges.sparkSession.createDataFrame([], "id string, community int, size int")
    held = scratch.table(e.join(of.toDF("s", "root"), "s").groupBy("root").agg(F.count("*").alias("edges")), "held")
    total, most = held.agg(F.sum("edges"), F.max("edges")).first()
    if most > MOST_EDGES:
        raise ValueError(f"a component of more than {MOST_EDGES} edges; take a neighbourhood or a sample of them")
    # one of more than a tenth of what a task may hold is a task of its own
    few = max(16, -(-total * 10 // MOST_EDGES))
    task = F.when(F.col("edges") * 10 > MOST_EDGES, F.struct(F.lit(-1).cast("long").alias("k"), "root")).otherwise(F.struct(F.pmod(F.xxhash64("root"), F.lit(few)).alias("k"), F.lit(0).cast("long").alias("root")))
    placed = scratch.table(of.join(held.select("root", task.alias("task")), "root").join(named, "n").select("n", "rank", "task"), "placed")
    links = e.join(placed.select(F.col("n").alias("s"), F.col("rank").alias("a"), "task"), "s").select("task", "o_id", "a").join(placed.select(F.col("n").alias("o_id"), F.col("rank").alias("b")), "o_id")
    found = scratch.table(links.select("task", "a", "b").groupBy("task").applyInPandas(_found(gamma, levels, 2.0 * total), "rank long, least long, size long"), "found")
    groups = found.select("least", "size").distinct().orderBy(F.desc("size"), "least").select("least", F.monotonically_increasing_id().alias("at"))
    groups = scratch.table(groups, "groups")
    before, upto = F.shiftright("at", 33), []  # partitions are numbered in the order of communities
    for r in groups.groupBy(before.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        upto.append((r.p, sum(n for _, _, n in upto[-1:]) + (upto[-1][1] if upto else 0), r.n))
    first = edges.sparkSession.createDataFrame([x[:2] for x in upto], "p long, first long")
    numbered = groups.withColumn("p", before).join(F.broadcast(first), "p").select("least", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("community"))
    return scratch.table(found.join(numbered, "least").join(named.select("rank", "id"), "rank").select("id", "community", F.col("size").cast("int").alias("size")), "communities")


def _found(gamma: float, levels: int, total: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Communities of whole components: rank of a node, the least rank and the size of its community."""
    moves, refined, connected = _moves, _refined, _connected

    def run(links: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        names, at = np.unique(np.concatenate([links.a.to_numpy(), links.b.to_numpy()]), return_inverse=True)
        a, b = at[: len(links)], at[len(links) :]
        u, v = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((v, u))
        cut, v = np.searchsorted(u[order], np.arange(len(names) + 1)), v[order]
        weights = first = {i: dict.fromkeys(v[cut[i] : cut[i + 1]].tolist(), 1.0) for i in range(len(names))}
        size = {u: float(len(vs)) for u, vs in weights.items()}
        node, start = {i: i for i in weights}, {i: i for i in weights}  # the node of this level that each first one is in
        member = dict(node)
        for _ in range(levels):
            of = moves(weights, size, gamma, total, start)
            member = {i: of[u] for i, u in node.items()}
            if len(set(of.values())) == len(weights):
                break
            part = refined(weights, size, gamma, total, of)
            merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
            mass: dict[int, float] = defaultdict(float)
            for u, vs in weights.items():
                mass[part[u]] += size[u]
                merged[part[u]]
                for w, x in vs.items():
                    merged[part[u]][part[w]] += x
            start = {part[u]: of[u] for u in weights}
            node = {i: part[u] for i, u in node.items()}
            weights, size = {u: dict(vs) for u, vs in merged.items()}, dict(mass)
        member = connected(first, member)
        least, count = {}, defaultdict(int)
        for i, c in member.items():
            least[c] = min(i, least.get(c, i))
            count[c] += 1
        return pd.DataFrame({"rank": names, "least": names[[least[member[i]] for i in range(len(names))]], "size": [count[member[i]] for i in range(len(names))]})

    return run
