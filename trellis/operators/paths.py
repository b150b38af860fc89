"""Paths: shortest, all shortest, simple and weighted, from pairs (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.storage import Scratch


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("s").alias("u"), "p", F.col("o_id").alias("v"))
    back = edges.select(F.col("o_id").alias("u"), "p", F.col("s").alias("v"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def shortest(edges: DataFrame, pairs: DataFrame, most: int = 5, direction: str = "out", every: bool = False) -> DataFrame:
    """(src, dst, nodes, rels, length). Of equal ones the least by nodes and types, or all if `every`.

    Nodes are first given their distance from each source; paths are then built back from the target, level by level, by
    edges that leave the source's own nodes of the level before, so that a hub's edges meet those of their source alone.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    step = scratch.table(_steps(edges, direction), "steps")
    want = scratch.table(pairs.select("src", "dst").distinct(), "pairs")
    levels = [scratch.table(want.select("src", F.col("src").alias("node")).distinct(), "d0")]
    seen = levels[0]
    for d in range(1, most + 1):
        new = levels[-1].join(step, F.col("node") == F.col("u")).select("src", F.col("v").alias("node")).distinct()
        new = scratch.table(new.join(seen, ["src", "node"], "left_anti"), f"d{d}")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionAll(new)
    begun = lambda d: want.join(levels[d].select("src", F.col("node").alias("dst")), ["src", "dst"]).select("src", "dst", F.col("dst").alias("at"), F.array("dst").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    now = begun(len(levels) - 1)
    for d in range(len(levels) - 1, 0, -1):
        # edges from the level before, of each source that has paths; then those that lead to where its paths are
        now = scratch.table(now, "open")
        before = levels[d - 1].join(now.select("src").distinct(), "src", "left_semi")
        into = before.join(step, F.col("node") == F.col("u")).select("src", "u", "p", F.col("v").alias("at"))
        back = now.join(into, ["src", "at"]).select("src", "dst", F.col("u").alias("at"), F.concat(F.array("u"), "nodes").alias("nodes"), F.concat(F.array("p"), "rels").alias("rels"))
        if not every:
            back = back.groupBy("src", "dst", "at").agg(F.min(F.struct("nodes", "rels")).alias("x")).select("src", "dst", "at", "x.nodes", "x.rels")
        now = back.unionAll(begun(d - 1))
    return scratch.table(now.select("src", "dst", "nodes", "rels", (F.size("nodes") - 1).alias("length")), "found")


def simple(edges: DataFrame, pairs: DataFrame, least: int = 1, most: int = 4, direction: str = "out") -> DataFrame:
    """(src, dst, nodes, length): every path without a repeated node."""
    scratch = Scratch(edges.sparkSession, "simple")
    step = scratch.table(_steps(edges, direction).select("u", "v").distinct(), "steps")
    now, out = pairs.select("src", "dst", F.array("src").alias("nodes")), None
    for n in range(1, most + 1):
        now = scratch.table(now.join(step, F.element_at("nodes", -1) == F.col("u")).where(~F.array_contains("nodes", F.col("v"))).select("src", "dst", F.concat("nodes", F.array("v")).alias("nodes")), f"n{n}")
        hit = now.where((F.element_at("nodes", -1) == F.col("dst")) & F.lit(n >= least)).withColumn("length", F.lit(n))
        out = hit if out is None else out.unionAll(hit)
    return out


def weighted(edges: DataFrame, sources: DataFrame, most_cost: float = 9999.0, hops: int = 10) -> DataFrame:
    """(src, node, cost, nodes): cheapest paths of at most `hops` edges; weights that are not positive count as 1."""
    scratch = Scratch(edges.sparkSession, "weighted")
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    step = scratch.table(edges.select(F.col("s").alias("u"), F.col("o_id").alias("v"), w.alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")), "steps")
    best = scratch.table(sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.array("src").alias("nodes")).distinct(), "best")
    changed = best
    for _ in range(hops):
        more = changed.join(step, F.col("node") == F.col("u")).select("src", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("nodes", F.array("v")).alias("nodes")).where(F.col("cost") <= most_cost)
        least = best.unionAll(more).groupBy("src", "node").agg(F.min(F.struct("cost", "nodes")).alias("x")).select("src", "node", "x.cost", "x.nodes")
        least = scratch.table(least, "best")
        old = best.select("src", "node", F.col("cost").alias("old"))
        changed = scratch.table(least.join(old, ["src", "node"], "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old"))).drop("old"), "changed")
        best = least
        if changed.isEmpty():
            break
    return best
