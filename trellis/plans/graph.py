"""A property graph as DataFrames: typed tables for labels and relationship types, and generic views over them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class NodeTable:
    """Rows of one label; `id` is the graph-wide id column, the other columns are typed properties."""

    df: DataFrame
    id: str = "id"

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != self.id]


@dataclass
class EdgeTable:
    """Edges of one type: columns s, o_id and typed properties."""

    df: DataFrame
    source: str | None = None
    target: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("s", "o_id")]


@dataclass
class Graph:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, EdgeTable] = field(default_factory=dict)
    named: dict[str, Graph] = field(default_factory=dict)
    procedures: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)

    # --- the table bridge
    def map_table(self, label: str, df: DataFrame, id_column: str, prefix: str | None = None, properties: list[str] | None = None) -> Graph:
        """A label backed by a table: ids are `prefix` + key, properties are its columns."""
        key = F.concat(F.lit(f"{label}:" if prefix is None else prefix), F.col(id_column).cast("string"))
        self.nodes[label] = NodeTable(df.select(key.alias("id"), *(properties or df.columns)))
        return self

    def map_relationship(self, kind: str, source: str, target: str, df: DataFrame, source_column: str, target_column: str, properties: list[str] | None = None) -> Graph:
        """A type backed by a foreign key (df is the source's table) or by a table between the two."""
        s = F.concat(F.lit(f"{source}:"), F.col(source_column).cast("string"))
        o = F.concat(F.lit(f"{target}:"), F.col(target_column).cast("string"))
        self.edges[kind] = EdgeTable(df.where(F.col(target_column).isNotNull()).select(s.alias("s"), o.alias("o_id"), *(properties or [])), source, target)
        return self

    def unmap(self, name: str) -> Graph:
        self.nodes.pop(name, None)
        self.edges.pop(name, None)
        return self

    def mappings(self) -> list[tuple[str, str]]:
        return [("node", k) for k in sorted(self.nodes)] + [("edge", k) for k in sorted(self.edges)]

    # --- generic views
    def edge_view(self, types: list[str] | None = None) -> DataFrame:
        """s, p, o_id, weight (1 where a type has none), qualifiers (a JSON object)."""
        made = []
        for kind in sorted(self.edges) if not types else [t for t in types if t in self.edges]:
            t = self.edges[kind]
            weight = F.col("weight").cast("double") if "weight" in t.props else F.lit(1.0)
            made.append(t.df.select("s", F.lit(kind).alias("p"), "o_id", weight.alias("weight"), (F.to_json(F.struct(*t.props)) if t.props else F.lit("{}")).alias("qualifiers")))
        return reduce(DataFrame.unionAll, made) if made else self.spark.createDataFrame([], "s string, p string, o_id string, weight double, qualifiers string")

    def node_view(self) -> DataFrame:
        """node_id, labels, props (strings): one row for each node, of however many labels."""
        made = [t.df.select(F.col(t.id).alias("node_id"), F.lit(k).alias("label"), _strings(t)) for k, t in sorted(self.nodes.items())]
        if not made:
            return self.spark.createDataFrame([], "node_id string, labels array<string>, props map<string,string>")
        rows = reduce(DataFrame.unionAll, made)
        merged = F.aggregate(F.collect_list("props"), F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(a, F.map_filter(m, lambda k, v: ~F.map_contains_key(a, k))))
        return rows.groupBy("node_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), merged.alias("props"))

    def label_view(self) -> DataFrame:
        made = [t.df.select(F.col(t.id).alias("s"), F.lit(k).alias("label")) for k, t in sorted(self.nodes.items())]
        return reduce(DataFrame.unionAll, made)

    def prop_view(self) -> DataFrame:
        """s, key, val: entity, attribute, value, all as strings."""
        made = [t.df.select(F.col(t.id).alias("s"), F.explode(_strings(t)).alias("key", "val")) for _, t in sorted(self.nodes.items())]
        return reduce(DataFrame.unionAll, made).where(F.col("val").isNotNull()).distinct()

    # --- queries
    def cypher(self, text: str, **params) -> DataFrame:
        from trellis.plans.planner import run

        return run(self, text, params)

    def update(self, text: str, **params):
        """Runs statements that change the graph; gives the new version and what the last RETURN gave."""
        from trellis.plans.updates import update

        return update(self, text, params)

    def aql(self, text: str, **params) -> DataFrame:
        from trellis.plans.aql import to_cypher

        return self.cypher(to_cypher(text), **params)

    def graphql(self, text: str, **variables) -> dict[str, DataFrame]:
        from trellis.plans.graphql import query

        return query(self, text, **variables)

    def status(self) -> dict:
        """What the graph has, and what the session is doing for it."""
        tracker = self.spark.sparkContext.statusTracker()
        return {"labels": sorted(self.nodes), "types": sorted(self.edges), "named": sorted(self.named), "indexes": {n: i.kind for n, i in self.indexes.items()}, "active_jobs": list(tracker.getActiveJobsIds()), "active_stages": list(tracker.getActiveStageIds())}

    def cancel(self, group: str) -> None:
        """Ends the jobs that were started under a job group (`SparkContext.setJobGroup`)."""
        self.spark.sparkContext.cancelJobGroup(group)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over views `nodes`, `edges` and one for each label and type that has a name SQL can say."""
        views = {"nodes": self.node_view(), "edges": self.edge_view()} | {k: t.df for k, t in {**self.edges, **self.nodes}.items() if k.isidentifier()}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)


def _strings(t: NodeTable):
    pairs = [x for c in t.props for x in (F.lit(c), F.col(c).cast("string"))]
    return (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).cast("map<string,string>").alias("props")
