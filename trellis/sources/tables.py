"""The driver's tables as a property graph, typed through the table bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.plans.graph import EdgeTable, Graph
from trellis.storage import read_table


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda n: read_table(spark, sf_dir, n)
    g = Graph(spark)
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey")):
        g.map_table(label, t(name), key)
    g.map_relationship("IN_REGION", "Nation", "Region", t("nation"), "n_nationkey", "n_regionkey")
    g.map_relationship("IN_NATION", "Customer", "Nation", t("customer"), "c_custkey", "c_nationkey")
    g.map_relationship("BASED_IN", "Supplier", "Nation", t("supplier"), "s_suppkey", "s_nationkey")
    g.map_relationship("PLACED", "Customer", "Order", t("orders"), "o_custkey", "o_orderkey")
    item = t("lineitem")
    grouped = lambda a, b: item.groupBy(a, b).agg(F.sum("l_quantity").alias("weight"), F.floor(1000 * (1 - F.max("l_discount"))).cast("int").alias("confidence"))
    g.map_relationship("CONTAINS", "Order", "Part", grouped("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", ["weight", "confidence"])
    g.map_relationship("SUPPLIED_BY", "Part", "Supplier", grouped("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", ["weight", "confidence"])
    return g


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o_id, weight: every part and its suppliers."""
    out = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return out.select(F.concat(F.lit("Part:"), "l_partkey").alias("s"), F.lit("SUPPLIED_BY").alias("p"), F.concat(F.lit("Supplier:"), "l_suppkey").alias("o_id"), "weight")


def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (Unix seconds), s, p, o, w, attrs from events."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.unix_timestamp("ts").alias("ts"), F.concat(F.lit("user:"), "user_id").alias("s"), F.col("event_type").alias("p"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("o"), F.col("value").alias("w"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"))


def chain_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations in a row: long paths with one label and one type."""
    c = read_table(spark, sf_dir, "conversations")
    ident = F.concat(F.lit("Turn:"), "conv_id", F.lit(":"), "turn")
    g = Graph(spark)
    g.map_table("Turn", c.select(F.concat("conv_id", F.lit(":"), "turn").alias("key"), "role", "turn"), "key")
    nxt = c.select(ident.alias("s"), F.concat(F.lit("Turn:"), "conv_id", F.lit(":"), F.col("turn") + 1).alias("o_id"))
    g.edges["NEXT"] = EdgeTable(nxt.join(c.select(ident.alias("o_id")), "o_id", "left_semi").select("s", "o_id"), "Turn", "Turn")
    return g
