"""Readers and writers: NDJSON, CSV, N-Triples and N-Quads, OBO, PROV, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = "kind string, type string, id string, labels array<string>, properties map<string,string>, props map<string,string>, source string, predicate string, target string, s string, p string, o string, timestamp long, weight double, attrs map<string,string>"
_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
TYPE_URI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_XSD = "http://www.w3.org/2001/XMLSchema#"


# --- NDJSON
def read_ndjson(spark: SparkSession, path: str, with_properties: bool = False) -> dict[str, DataFrame]:
    """nodes(node_id, labels, props), edges(s, p, o_id; with_properties also props), temporal(ts, s, p, o, w, attrs). Lines
    that are not taken are in `rejected_lines`."""
    rows = spark.read.schema(_LINE).option("mode", "DROPMALFORMED").json(path).withColumn("k", F.coalesce("kind", "type"))
    s, p, o = F.coalesce("source", "s"), F.coalesce("predicate", "p"), F.coalesce("target", "o")
    return {
        "nodes": rows.where("k = 'node'").select(F.col("id").alias("node_id"), F.coalesce("labels", F.array()).alias("labels"), F.coalesce("properties", "props").alias("props")),
        "edges": rows.where("k = 'edge'").select(s.alias("s"), p.alias("p"), o.alias("o_id"), *([F.coalesce("properties", "props").alias("props")] if with_properties else [])),
        "temporal": rows.where("k = 'temporal_edge'").select(F.col("timestamp").alias("ts"), s.alias("s"), p.alias("p"), o.alias("o"), F.coalesce("weight", F.lit(1.0)).alias("w"), "attrs"),
    }


def ndjson_lines(nodes: DataFrame | None = None, edges: DataFrame | None = None, temporal: DataFrame | None = None) -> DataFrame:
    made = []
    if nodes is not None:
        made.append(nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "labels", F.col("props").alias("properties"))).alias("value")))
    if edges is not None:
        made.append(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("s").alias("source"), F.col("p").alias("predicate"), F.col("o_id").alias("target"))).alias("value")))
    if temporal is not None:
        made.append(temporal.select(F.to_json(F.struct(F.lit("temporal_edge").alias("kind"), F.col("s").alias("source"), F.col("p").alias("predicate"), F.col("o").alias("target"), F.col("ts").alias("timestamp"), F.col("w").alias("weight"), "attrs")).alias("value")))
    out = made[0]
    for m in made[1:]:
        out = out.unionAll(m)
    return out


def temporal_lines(edges: DataFrame, start: int | None = None, end: int | None = None, predicate: str | None = None) -> DataFrame:
    """Temporal edges of a window and type, one JSON line each."""
    for test in (None if start is None else F.col("ts") >= start, None if end is None else F.col("ts") <= end, None if predicate is None else F.col("p") == predicate):
        edges = edges if test is None else edges.where(test)
    return ndjson_lines(temporal=edges)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines that are no JSON object or have no kind that is known."""
    kind = F.coalesce(F.get_json_object("value", "$.kind"), F.get_json_object("value", "$.type"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).where(kind.isNull() | ~kind.isin("node", "edge", "temporal_edge"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


# --- CSV and networks
def read_csv_edges(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.schema("s string, p string, o_id string").option("header", header).csv(path).where("s IS NOT NULL AND o_id IS NOT NULL")


def from_network(spark: SparkSession, graph, label: str = "label") -> dict[str, DataFrame]:
    """Nodes and edges of an object with nodes(data=True) and edges(data=True)."""
    nodes = [(str(n), [str(d[label])] if label in d else [], {k: str(v) for k, v in d.items() if k != label}) for n, d in graph.nodes(data=True)]
    edges = [(str(a), str(d.get("predicate", "RELATED")), str(b), json.dumps({k: v for k, v in d.items() if k != "predicate"})) for a, b, d in graph.edges(data=True)]
    return {"nodes": spark.createDataFrame(nodes, "node_id string, labels array<string>, props map<string,string>"), "edges": spark.createDataFrame(edges, "s string, p string, o_id string, qualifiers string")}


# --- RDF
def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, literal, lang, graph of N-Triples or N-Quads lines; comments and broken lines are dropped."""
    line = F.trim("value")
    whole = rf"^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:\S+)?\s*\.$"
    rows = spark.read.text(path).where(~line.startswith("#") & line.rlike(whole))
    bare = lambda x: F.regexp_replace(x, "^<|>$", "")
    o = F.regexp_extract(line, whole, 3)
    literal = o.startswith('"')
    text = F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")
    return rows.select(
        bare(F.regexp_extract(line, whole, 1)).alias("s"), bare(F.regexp_extract(line, whole, 2)).alias("p"), F.when(literal, text).otherwise(bare(o)).alias("o"),
        literal.alias("literal"), F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("lang"), F.nullif(bare(F.regexp_extract(line, whole, 4)), F.lit("")).alias("graph"),
    )


def local_name(uri):
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def triples_to_graph(triples: DataFrame) -> dict[str, DataFrame]:
    """Types become labels, other URIs edges, literals properties under the local name (`<name>_lang` has languages)."""
    typed, key = F.col("p") == TYPE_URI, local_name(F.col("p"))
    props = triples.where("literal").select("s", F.explode(F.filter(F.array(F.struct(key.alias("key"), F.col("o").alias("val")), F.struct(F.concat(key, F.lit("_lang")).alias("key"), F.col("lang").alias("val"))), lambda x: x["val"].isNotNull())).alias("x")).select("s", "x.key", "x.val")
    return {
        "labels": triples.where(typed).select("s", local_name(F.col("o")).alias("label")).distinct(),
        "props": props, "edges": triples.where("NOT literal").where(~typed).select("s", key.alias("p"), F.col("o").alias("o_id"), F.col("graph").alias("graph_id")),
    }


def _uri(x):
    return F.concat(F.lit("<"), F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("urn:trellis:"), F.regexp_replace(x, r"[\s<>\"{}|\\^`]", "_"))), F.lit(">"))


def _literal(x):
    kind = F.when(x.rlike("^[+-]?[0-9]+$"), "integer").when(x.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal").when(x.isin("true", "false"), "boolean").otherwise("string")
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit(f'"^^<{_XSD}'), kind, F.lit(">"))


def rdf_lines(labels: DataFrame | None = None, props: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """N-Triples: labels as types, properties as typed literals, edges as triples."""
    made = []
    if labels is not None:
        made.append(labels.select(F.concat_ws(" ", _uri(F.col("s")), F.lit(f"<{TYPE_URI}>"), _uri(F.col("label")), F.lit(".")).alias("value")))
    if props is not None:
        made.append(props.select(F.concat_ws(" ", _uri(F.col("s")), _uri(F.col("key")), _literal(F.col("val")), F.lit(".")).alias("value")))
    if edges is not None:
        made.append(edges.select(F.concat_ws(" ", _uri(F.col("s")), _uri(F.col("p")), _uri(F.col("o_id")), F.lit(".")).alias("value")))
    out = made[0]
    for m in made[1:]:
        out = out.unionAll(m)
    return out


def prov_lines(temporal: DataFrame) -> DataFrame:
    """Each temporal edge is an activity with a start, what it used, and its predicate's object."""
    prov = "http://www.w3.org/ns/prov#"
    a = _uri(F.concat_ws(":", F.lit("activity"), "ts", "s", "p", "o"))
    start = F.concat(F.lit('"'), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f'"^^<{_XSD}dateTime>'))
    parts = [(f"<{TYPE_URI}>", F.lit(f"<{prov}Activity>")), (f"<{prov}startedAtTime>", start), (f"<{prov}used>", _uri(F.col("s")))]
    lines = [F.concat_ws(" ", a, F.lit(p), o, F.lit(".")) for p, o in parts] + [F.concat_ws(" ", a, _uri(F.col("p")), _uri(F.col("o")), F.lit("."))]
    return temporal.select(F.explode(F.array(*lines)).alias("value"))


# --- OBO
def read_obo(spark: SparkSession, path: str, prefix: str = "") -> dict[str, DataFrame]:
    """Terms as nodes, is_a and part_of as edges; stanzas are split by the reader."""
    stanza = spark.read.option("lineSep", "[Term]").text(path).where(F.col("value").rlike(r"(?m)^id: "))
    one = lambda key: F.regexp_extract("value", rf"(?m)^{key}: ([^\n!]*?)\s*(?:!.*)?$", 1)
    many = lambda pattern: F.regexp_extract_all("value", F.lit(pattern), 1)
    ident = F.concat(F.lit(prefix), one("id"))
    is_a = stanza.select(ident.alias("s"), F.lit("is_a").alias("p"), F.explode(many(r"(?m)^is_a: (\S+)")).alias("o"))
    part = stanza.select(ident.alias("s"), F.lit("part_of").alias("p"), F.explode(many(r"(?m)^relationship: part_of (\S+)")).alias("o"))
    return {"nodes": stanza.select(ident.alias("node_id"), F.array(F.lit("Term")).alias("labels"), F.create_map(F.lit("name"), one("name")).alias("props")), "edges": is_a.unionAll(part).select("s", "p", F.concat(F.lit(prefix), "o").alias("o_id"))}


# --- snapshots
def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each, and a manifest of names and schemas."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def snapshot_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, schema string").json(f"{path}/manifest")


def restore_snapshot(spark: SparkSession, path: str, into: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables; merged with `into` (distinct rows) or replacing it."""
    found = {r.name: spark.read.parquet(f"{path}/{r.name}") for r in snapshot_info(spark, path).collect()}
    return found if into is None else {n: df.unionByName(into[n]).distinct() if n in into else df for n, df in found.items()} | {n: df for n, df in into.items() if n not in found}
