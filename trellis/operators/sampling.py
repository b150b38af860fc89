"""Bounded looks at a graph: pages, early exits, fan-out samples, neighbourhood aggregates, guided subgraphs.

Which rows a bound lets through is always defined: by order of ids, or by a hash of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators import analytics, traversal
from trellis.storage import Scratch

#: parts that a node's neighbours are first ranked in, so that a hub is not one task's work
PARTS = 32


def page(found: DataFrame, size: int, after: tuple | None = None, by: tuple[str, ...] = ("hop", "node")) -> DataFrame:
    """The `size` rows that come next after the key `after`, in order of the columns `by`; the last row's is the next
    cursor. Nothing is held between pages."""
    if after is not None:
        key, at = F.struct(*by), F.struct(*(F.lit(v).cast(found.schema[c].dataType).alias(c) for c, v in zip(by, after, strict=True)))
        found = found.where(key > at)
    return found.orderBy(*by).limit(size)


def first_reached(edges: DataFrame, seeds: DataFrame, most: int, hops: int = 10, direction: str = "out") -> DataFrame:
    """(src, node, hop) of the `most` nodes that are nearest, then least by name; hops end as soon as there are enough."""
    scratch = Scratch(edges.sparkSession, "first-reached")
    step = scratch.table(traversal.oriented(edges, direction), "edges")
    seen = scratch.table(seeds.select("src", F.col("src").alias("node"), F.lit(0).alias("hop")).distinct(), "seen")
    frontier, found = seen, 0
    for hop in range(1, hops + 1):
        new = frontier.select("src", "node").join(step, F.col("node") == F.col("s")).select("src", F.col("o_id").alias("node")).distinct()
        frontier = scratch.table(new.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        n = frontier.count()
        seen, found = seen.unionAll(frontier), found + n
        if not n or found >= most:
            break
    return seen.where("hop > 0").orderBy("hop", "node", "src").limit(most)


def sample_hops(edges: DataFrame, seeds: DataFrame, hops: int, fanout: int, seed: int = 0) -> DataFrame:
    """(src, hop, s, o_id): of each node met, at most `fanout` distinct neighbours, those of least hash."""
    scratch = Scratch(edges.sparkSession, "sample")
    drawn = F.xxhash64("s", "o_id", F.lit(seed))
    few = edges.select("s", "o_id").distinct().withColumns({"by": drawn, "part": F.pmod(drawn, F.lit(PARTS))})
    for keys in (["s", "part"], ["s"]):
        few = few.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("by", "o_id"))).where(F.col("k") <= fanout)
    few = scratch.table(few.select("s", "o_id"), "few")
    frontier, out = seeds.select("src", F.col("src").alias("node")).distinct(), None
    for hop in range(1, hops + 1):
        got = scratch.table(frontier.join(few, F.col("node") == F.col("s")).select("src", F.lit(hop).alias("hop"), "s", "o_id").distinct(), f"hop{hop}")
        out = got if out is None else out.unionAll(got)
        frontier = got.select("src", F.col("o_id").alias("node")).distinct()
    return out


def neighbor_aggregate(edges: DataFrame, features: DataFrame, how: str = "mean", direction: str = "out") -> DataFrame:
    """id, features, n: the element-wise sum, mean or greatest of neighbours' features(id, features), an array; each
    place is aggregated by itself, so that a hub's neighbours never meet in one row."""
    step = traversal.oriented(edges, direction)
    placed = step.join(features.select(F.col("id").alias("o_id"), F.posexplode("features").alias("i", "x")), "o_id")
    made = {"sum": F.sum("x"), "mean": F.mean("x"), "max": F.max("x")}[how]
    each = placed.groupBy("s", "i").agg(made.alias("x"), F.count("*").alias("n"))
    return each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("f"), F.max("n").alias("n")).select(F.col("s").alias("id"), F.transform("f", lambda v: v["x"]).alias("features"), "n")


def node_statistics(edges: DataFrame, labels: DataFrame, node: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """metric, value of one node: out and in degree, types of its edges, and 1 or 0 for each label asked about."""
    out, back = edges.where(F.col("s") == node), edges.where(F.col("o_id") == node)
    rows = out.agg(F.count("*").alias("out_degree"), F.count_distinct("p").alias("predicates")).crossJoin(back.agg(F.count("*").alias("in_degree")))  # one row each
    own = labels.where(F.col("s") == node).agg(*(F.coalesce(F.max((F.col("label") == x).cast("long")), F.lit(0)).alias(f"is_{x}") for x in flags)) if flags else None
    rows = rows if own is None else rows.crossJoin(own)
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in rows.columns))).alias("r")).select("r.*")


def guided_subgraph(edges: DataFrame, seeds: list[str], top: int = 50, share: float = 0.01, hops: int = 2, **how) -> DataFrame:
    """s, p, o_id, weight: edges between the nodes that personalised PageRank ranks best (at least `share` of the best
    score, at most `top` of them, ties to the lesser id) and that lie within `hops` of the seeds."""
    scratch = Scratch(edges.sparkSession, "guided")
    rank = scratch.table(analytics.personalized_pagerank(edges, seeds, **how), "rank")
    best = rank.agg(F.max("score")).first()[0] or 0.0
    good = rank.where(F.col("score") >= share * best).orderBy(F.desc("score"), "id").limit(top).select("id")
    start = edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "src string")
    near = traversal.reach(edges, start, 0, hops).select(F.col("node").alias("id")).distinct()
    keep = scratch.table(good.join(near, "id", "left_semi"), "keep")
    return edges.join(keep.toDF("s"), "s", "left_semi").join(keep.toDF("o_id"), "o_id", "left_semi").select("s", "p", "o_id", "weight")


def two_hop_count(edges: DataFrame) -> DataFrame:
    """s, paths: 2-hop paths from degrees alone; no path is made."""
    e = edges.select("s", "o_id").distinct()
    degree = e.groupBy("s").agg(F.count("*").alias("k")).toDF("o_id", "k")
    return e.join(degree, "o_id").groupBy("s").agg(F.sum("k").alias("paths"))
