"""Updates as new versions of tables nodes(node_id), labels(s, label), props(s, key, val), edges(s, p, o_id, ..)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    nodes: DataFrame
    labels: DataFrame
    props: DataFrame
    edges: DataFrame

    def create_nodes(self, new: DataFrame) -> Store:
        """new(node_id, labels, props): ids, labels and non-null properties that are not there yet."""
        props = new.select(F.col("node_id").alias("s"), F.explode("props").alias("key", "val")).where(F.col("val").isNotNull())
        return replace(
            self, nodes=self.nodes.unionByName(new.select("node_id").distinct().join(self.nodes, "node_id", "left_anti")),
            labels=self.labels.union(new.select(F.col("node_id").alias("s"), F.explode("labels").alias("label"))).distinct(),
            props=self.props.unionByName(props.join(self.props.select("s", "key"), ["s", "key"], "left_anti").dropDuplicates(["s", "key"])),
        )

    def create_edges(self, new: DataFrame) -> Store:
        keys = ["s", "p", "o_id"]
        return replace(self, edges=self.edges.unionByName(new.dropDuplicates(keys).join(self.edges.select(keys), keys, "left_anti"), allowMissingColumns=True))

    def merge_nodes(self, new: DataFrame, on_create: dict[str, str] | None = None, on_match: dict[str, str] | None = None) -> Store:
        """Nodes that are missing are made; ON CREATE sets properties of those, ON MATCH of the others."""
        made, met = new.join(self.nodes, "node_id", "left_anti"), new.join(self.nodes, "node_id", "left_semi")
        out = self.create_nodes(new)
        for ids, changes in ((made, on_create), (met, on_match)):
            for k, v in (changes or {}).items():
                out = out.set_props(ids.select(F.col("node_id").alias("s"), F.lit(k).alias("key"), F.lit(v).alias("val")))
        return out

    def set_props(self, changes: DataFrame) -> Store:
        """changes(s, key, val) replace or add; a null takes the property away. Of several for one property the greatest
        stays, and a null only where there is nothing else."""
        changes = changes.groupBy("s", "key").agg(F.max("val").alias("val"))
        rest = self.props.join(changes.select("s", "key"), ["s", "key"], "left_anti")
        return replace(self, props=rest.unionByName(changes.select("s", "key", "val").where(F.col("val").isNotNull())))

    def remove_props(self, keys: DataFrame) -> Store:
        return replace(self, props=self.props.join(keys.select("s", "key"), ["s", "key"], "left_anti"))

    def set_labels(self, new: DataFrame) -> Store:
        return replace(self, labels=self.labels.union(new.select("s", "label")).distinct())

    def remove_labels(self, gone: DataFrame) -> Store:
        return replace(self, labels=self.labels.join(gone.select("s", "label"), ["s", "label"], "left_anti"))

    def delete_edges(self, gone: DataFrame) -> Store:
        """The exact triples."""
        return replace(self, edges=self.edges.join(gone.select("s", "p", "o_id"), ["s", "p", "o_id"], "left_anti"))

    def delete_nodes(self, gone: DataFrame, detach: bool = False) -> Store:
        ids = gone.select("node_id").distinct()
        touching = self.edges.join(ids.toDF("s"), "s", "left_semi").unionByName(self.edges.join(ids.toDF("o_id"), "o_id", "left_semi"))
        if not detach and not touching.isEmpty():
            raise ValueError("nodes with edges are deleted with detach=True only")
        s = ids.toDF("s")
        return Store(self.nodes.join(ids, "node_id", "left_anti"), self.labels.join(s, "s", "left_anti"), self.props.join(s, "s", "left_anti"), self.edges.join(s, "s", "left_anti").join(ids.toDF("o_id"), "o_id", "left_anti"))

    def verify(self) -> DataFrame:
        """problem, n: what does not fit together; no rows if all does."""
        ids = self.nodes.select(F.col("node_id").alias("s"))
        found = {
            "edges without a source": self.edges.join(ids, "s", "left_anti"), "edges without a target": self.edges.join(ids.toDF("o_id"), "o_id", "left_anti"), "labels without a node": self.labels.join(ids, "s", "left_anti"),
            "properties without a node": self.props.join(ids, "s", "left_anti"), "nodes given twice": self.nodes.groupBy("node_id").count().where("count > 1"),
        }
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("problem"), "n") for k, df in found.items()]
        return reduce(DataFrame.unionAll, rows).where("n > 0")

    def healed(self) -> Store:
        """Without what `verify` finds."""
        nodes = self.nodes.dropDuplicates(["node_id"])
        ids = nodes.select(F.col("node_id").alias("s"))
        return Store(nodes, self.labels.join(ids, "s", "left_semi"), self.props.join(ids, "s", "left_semi"), self.edges.join(ids, "s", "left_semi").join(ids.toDF("o_id"), "o_id", "left_semi").select(*self.edges.columns))

    def set_weight(self, s: str, p: str, o: str, weight: float) -> Store:
        hit = (F.col("s") == s) & (F.col("p") == p) & (F.col("o_id") == o)
        return replace(self, edges=self.edges.withColumn("weight", F.when(hit, F.lit(weight)).otherwise(F.col("weight"))))


def adjacency(edges: DataFrame) -> DataFrame:
    """s, p, o_id, weight, degree: distinct edges with the out degree by type, the derived table that lookups read."""
    e = edges.groupBy("s", "p", "o_id").agg(F.max("weight").alias("weight"))
    return e.join(e.groupBy("s", "p").agg(F.count("*").alias("degree")), ["s", "p"])


def reified(edges: DataFrame, reifiers: DataFrame, reifier: str) -> DataFrame:
    """The edge that a reifier stands for."""
    one = reifiers.where(F.col("reifier_id") == reifier).select("s", "p", "o_id")
    return edges.join(F.broadcast(one), ["s", "p", "o_id"], "left_semi")


def unreify(reifiers: DataFrame, gone: DataFrame) -> DataFrame:
    return reifiers.join(gone.select("reifier_id"), "reifier_id", "left_anti")


def reify(edges: DataFrame) -> DataFrame:
    """reifier_id, s, p, o_id: a node for each edge, named by a hash of it."""
    return edges.select(F.concat(F.lit("reif:"), F.substring(F.sha2(F.concat_ws("|", "s", "p", "o_id"), 256), 1, 16)).alias("reifier_id"), "s", "p", "o_id").distinct()
