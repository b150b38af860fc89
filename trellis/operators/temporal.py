"""Time-stamped edges (ts in Unix seconds, s, p, o, w, attrs): windows, 300-second buckets, velocity, bursts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.traversal import reach

BUCKET = 300


def append(edges: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """New edges joined to old; of one (ts, s, p, o), the new weight wins, or the old one stays."""
    keys = ["ts", "s", "p", "o"]
    fresh = new.dropDuplicates(keys)
    if overwrite:
        return edges.join(fresh.select(keys), keys, "left_anti").unionByName(fresh)
    return edges.unionByName(fresh.join(edges.select(keys), keys, "left_anti"))


def window(edges: DataFrame, start: int, end: int, source: str | None = None, predicate: str | None = None, direction: str = "out") -> DataFrame:
    """Edges with start <= ts <= end; `source` is the target if direction is `in`."""
    out = edges.where(F.col("ts").between(start, end))
    if source is not None:
        out = out.where(F.col("s" if direction == "out" else "o") == source)
    return out if predicate is None else out.where(F.col("p") == predicate)


def bucketed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("bucket", F.floor(F.col("ts") / BUCKET))


def aggregate(edges: DataFrame, start: int, end: int, source: str | None = None, predicate: str | None = None, exact: bool = False) -> DataFrame:
    """One row of count, sum, avg, min, max over the buckets that the window touches, or over its exact bounds."""
    e = window(edges, start, end, source, predicate) if exact else window(edges, start // BUCKET * BUCKET, end // BUCKET * BUCKET + BUCKET - 1, source, predicate)
    return e.agg(F.count("*").alias("n"), F.sum("w").alias("sum"), F.avg("w").alias("avg"), F.min("w").alias("min"), F.max("w").alias("max"))


def bucket_stats(edges: DataFrame) -> DataFrame:
    """Pre-aggregation by bucket, source and predicate, with a sketch of targets that can be merged later."""
    return bucketed(edges).groupBy("bucket", "s", "p").agg(F.count("*").alias("n"), F.sum("w").alias("sum"), F.min("w").alias("min"), F.max("w").alias("max"), F.hll_sketch_agg("o").alias("targets"))


def bucket_groups(edges: DataFrame, start: int, end: int, predicate: str | None = None, prefix: str = "") -> DataFrame:
    """s, p and their statistics over whole buckets."""
    e = window(edges, start // BUCKET * BUCKET, end // BUCKET * BUCKET + BUCKET - 1, None, predicate).where(F.startswith("s", F.lit(prefix)))
    return e.groupBy("s", "p").agg(F.count("*").alias("n"), F.sum("w").alias("sum"), F.avg("w").alias("avg"), F.min("w").alias("min"), F.max("w").alias("max"))


def targets(edges: DataFrame, source: str, predicate: str, start: int, end: int) -> DataFrame:
    return window(edges, start, end, source, predicate).select("o").distinct()


def distinct_targets(edges: DataFrame, start: int, end: int, approximate: bool = False) -> DataFrame:
    """s, p, n: distinct targets within the window."""
    count = F.approx_count_distinct("o") if approximate else F.count_distinct("o")
    return window(edges, start, end).groupBy("s", "p").agg(count.alias("n"))


def velocity(edges: DataFrame, node: str, now: int, seconds: int) -> DataFrame:
    """n: edges out of the node in buckets from now - seconds to now."""
    e = bucketed(edges).where((F.col("s") == node) & F.col("bucket").between((now - seconds) // BUCKET, now // BUCKET))
    return e.agg(F.count("*").alias("n"))


def bursts(edges: DataFrame, now: int, seconds: int, threshold: int, predicate: str | None = None) -> DataFrame:
    """s, n of nodes with at least `threshold` edges in those buckets."""
    e = edges if predicate is None else edges.where(F.col("p") == predicate)
    e = bucketed(e).where(F.col("bucket").between((now - seconds) // BUCKET, now // BUCKET))
    return e.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def attributes(edges: DataFrame, ts: int, s: str, p: str, o: str) -> DataFrame:
    return edges.where((F.col("ts") == ts) & (F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).select(F.explode("attrs").alias("key", "val"))


def purge_before(edges: DataFrame, ts: int) -> DataFrame:
    """What is left when edges up to ts are gone."""
    return edges.where(F.col("ts") > ts)


def temporal_reach(edges: DataFrame, seeds: DataFrame, start: int, end: int, hops: int = 2, direction: str = "out") -> DataFrame:
    """(src, node, hop) along edges of a window."""
    return reach(window(edges, start, end).select("s", F.col("o").alias("o_id")), seeds, 1, hops, direction)


def rolling(edges: DataFrame, now: int) -> DataFrame:
    """s, n_24h, sum_24h, targets_7d as of `now`."""
    day, week = F.col("ts") > now - 86_400, F.col("ts") > now - 7 * 86_400
    e = edges.where(week & (F.col("ts") <= now))
    return e.groupBy("s").agg(F.count(F.when(day, 1)).alias("n_24h"), F.coalesce(F.sum(F.when(day, F.col("w"))), F.lit(0.0)).alias("sum_24h"), F.count_distinct("o").alias("targets_7d"))
