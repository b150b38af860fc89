"""Breadth-first operators over edges(s, o_id): a loop of joins, each round written so that lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.storage import Scratch


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (s, o_id) in the direction of travel."""
    out = edges.select("s", "o_id")
    back = edges.select(F.col("o_id").alias("s"), F.col("s").alias("o_id"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def reach(edges: DataFrame, seeds: DataFrame, least: int = 1, most: int = 10, direction: str = "out") -> DataFrame:
    """(src, node, hop): what seeds(src) reach, at the hop at which it is first reached, for least <= hop <= most."""
    scratch = Scratch(edges.sparkSession, "reach")
    step = scratch.table(oriented(edges, direction), "edges")
    seen = scratch.table(seeds.select("src", F.col("src").alias("node"), F.lit(0).alias("hop")).distinct(), "seen")
    frontier = seen
    for hop in range(1, most + 1):
        new = frontier.select("src", "node").join(step, F.col("node") == F.col("s")).select("src", F.col("o_id").alias("node")).distinct()
        new = scratch.table(new.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        if new.isEmpty():
            break
        seen, frontier = seen.unionAll(new), new
    return seen.where(F.col("hop").between(least, most))


def khop(edges: DataFrame, seed: str, hops: int, direction: str = "out") -> DataFrame:
    """(id, dist) of nodes within `hops`, the seed left out."""
    seeds = edges.sparkSession.createDataFrame([(seed,)], "src string")
    return reach(edges, seeds, 1, hops, direction).select(F.col("node").alias("id"), F.col("hop").alias("dist"))


def bfs_edges(edges: DataFrame, seeds: DataFrame, hops: int, preds: list[str] | None = None) -> DataFrame:
    """(s, p, o, w, step): edges out of each hop's frontier; hop i follows preds[i], the last for all further ones."""
    scratch = Scratch(edges.sparkSession, "bfs")
    seen = scratch.table(seeds.select(F.col("src").alias("node")).distinct(), "seen")
    frontier, out = seen, None
    for i in range(hops):
        step = edges if not preds else edges.where(F.col("p") == preds[min(i, len(preds) - 1)])
        found = scratch.table(step.join(frontier, F.col("s") == F.col("node"), "left_semi").select("s", "p", F.col("o_id").alias("o"), F.col("weight").alias("w"), F.lit(i + 1).alias("step")), f"hop{i}")
        out = found if out is None else out.unionAll(found)
        frontier = scratch.table(found.select(F.col("o").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return out


def two_hop(edges: DataFrame) -> DataFrame:
    """(s, paths, nodes): 2-hop paths of each node, and distinct nodes at distance 2 exactly."""
    e = edges.select("s", "o_id").distinct()
    pairs = e.join(e.toDF("m", "t"), F.col("o_id") == F.col("m")).select("s", "t")
    ways = e.groupBy("s").agg(F.count("*").alias("k")).toDF("o_id", "k")
    counts = e.join(ways, "o_id").groupBy("s").agg(F.sum("k").alias("paths"))  # from degrees, without making paths
    exact = pairs.where("s <> t").distinct().join(e.toDF("s", "t"), ["s", "t"], "left_anti").groupBy("s").agg(F.count("*").alias("nodes"))
    return counts.join(exact, "s", "left").select("s", "paths", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


def degrees(edges: DataFrame) -> DataFrame:
    """(s, p, degree) over distinct edges."""
    return edges.select("s", "p", "o_id").distinct().groupBy("s", "p").agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, source: str, predicate: str | None = None, direction: str = "out") -> DataFrame:
    e = edges if predicate is None else edges.where(F.col("p") == predicate)
    out, back = e.where(F.col("s") == source).select(F.col("o_id").alias("neighbor")), e.where(F.col("o_id") == source).select(F.col("s").alias("neighbor"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def meta_path(edges: DataFrame, source: str, first: str, second: str) -> DataFrame:
    """(path_id, step, s, p, o): edges of one predicate, then of another from where they lead."""
    one = edges.where((F.col("s") == source) & (F.col("p") == first)).select("s", "p", F.col("o_id").alias("o"))
    two = edges.where(F.col("p") == second).select("s", "p", F.col("o_id").alias("o")).join(one.select(F.col("o").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o")
    return one.select(F.lit(1).alias("path_id"), F.lit(1).alias("step"), "s", "p", "o").unionAll(two.select(F.lit(1).alias("path_id"), F.lit(2).alias("step"), "s", "p", "o"))


def neighborhood_expansion(edges: DataFrame, entities: list[str], confidence: int) -> DataFrame:
    """Distinct out edges of the entities whose qualifiers have at least that confidence."""
    conf = F.get_json_object("qualifiers", "$.confidence").cast("int")
    return edges.where(F.col("s").isin(*entities)).select("s", "p", "o_id", conf.alias("confidence")).where(F.col("confidence") >= confidence).distinct()


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges between nodes within `hops` out hops of the seeds."""
    nodes = reach(edges, seeds, 0, hops).select("node").distinct()
    return edges.join(nodes.withColumnRenamed("node", "s"), "s", "left_semi").join(nodes.withColumnRenamed("node", "o_id"), "o_id", "left_semi").select("s", "p", "o_id", "weight")


def structural_guard(edges: DataFrame, preds: list[str]) -> DataFrame:
    """Nodes with an out edge of every predicate."""
    return edges.where(F.col("p").isin(*preds)).groupBy("s").agg(F.count_distinct("p").alias("n")).where(F.col("n") == len(set(preds))).select("s")


def random_walks(edges: DataFrame, seeds: DataFrame, length: int, walks: int = 1, seed: int = 0) -> DataFrame:
    """(src, walk, step, node): a uniform next neighbour by a hash of the walk, until a sink."""
    scratch = Scratch(edges.sparkSession, "walk")
    # neighbours are numbered from 0 within parts of a node, and parts follow each other, so that a hub is many tasks' work
    part = edges.select("s", "o_id").distinct().withColumn("part", F.pmod(F.xxhash64("o_id"), F.lit(64)))
    sizes = part.groupBy("s", "part").agg(F.count("*").alias("n"))
    of_node = Window.partitionBy("s")
    upto = sizes.select("s", "part", (F.sum("n").over(of_node.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(of_node).alias("degree"))
    at = F.row_number().over(Window.partitionBy("s", "part").orderBy("o_id")) - 1
    numbered = scratch.table(part.withColumn("i", at).join(upto, ["s", "part"]).select("s", (F.col("i") + F.col("before")).alias("i"), "o_id"), "numbered")
    degree = scratch.table(upto.select("s", "degree").distinct(), "degree")
    now = scratch.table(seeds.select("src", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.lit(0).alias("step"), F.col("src").alias("node")), "start")
    out = now
    for i in range(1, length + 1):
        pick = F.pmod(F.xxhash64("src", "walk", F.lit(i), F.lit(seed)), F.col("degree"))
        drawn = now.join(degree, F.col("node") == F.col("s")).select("src", "walk", "s", pick.alias("i"))
        now = scratch.table(drawn.join(numbered, ["s", "i"]).select("src", "walk", F.lit(i).alias("step"), F.col("o_id").alias("node")), f"step{i}")
        out = out.unionAll(now)
    return out
