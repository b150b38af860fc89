"""Clinical events in FHIR's JSON: codes to nodes, and codes to the graph's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import analytics

_CODING = "array<struct<system:string,code:string,display:string>>"
_RESOURCE = f"resourceType string, id string, subject struct<reference:string>, encounter struct<reference:string>, code struct<coding:{_CODING},text:string>, recordedDate string, onsetDateTime string, effectiveDateTime string"


def events(lines: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Resources, one JSON text a row, to nodes(node_id, labels, props) of codes, and temporal edges(ts, s, p, o, w, attrs)
    from subject to code. Resources without a subject, a code or a date give no edge; texts that are no JSON give nothing."""
    r = lines.select(F.from_json(F.col(column), _RESOURCE).alias("r")).select("r.*").where("resourceType IS NOT NULL")
    each = r.select("resourceType", F.col("id").alias("resource"), F.col("subject.reference").alias("s"), F.col("encounter.reference").alias("encounter"), F.to_timestamp(F.coalesce("recordedDate", "onsetDateTime", "effectiveDateTime")).alias("at"), F.explode("code.coding").alias("c"))
    each = each.where("c.code IS NOT NULL").withColumn("o", F.concat_ws(":", F.element_at(F.split("c.system", "/"), -1), "c.code"))
    nodes = each.groupBy(F.col("o").alias("node_id")).agg(F.array(F.lit("Code")).alias("labels"), F.create_map(F.lit("code"), F.min("c.code"), F.lit("system"), F.min("c.system"), F.lit("display"), F.min("c.display")).alias("props"))
    edges = each.where("s IS NOT NULL AND at IS NOT NULL").select(F.unix_timestamp("at").alias("ts"), "s", F.upper("resourceType").alias("p"), "o", F.lit(1.0).alias("w"), F.create_map(F.lit("resource"), F.col("resource"), F.lit("encounter"), F.col("encounter")).alias("attrs"))
    return {"nodes": nodes, "edges": edges}


def icd_codes(texts: DataFrame, text: str = "text") -> DataFrame:
    """code: distinct ICD-10 codes that texts name."""
    return texts.select(F.explode(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?)\b"), 1)).alias("code")).distinct()


def anchors(codes: DataFrame, bridges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """id: distinct graph nodes that bridges(fhir_code, kg_node_id, confidence) lead to from codes(code), if they exist."""
    met = bridges.where(F.col("confidence") >= least).join(codes.select(F.col("code").alias("fhir_code")).distinct(), "fhir_code", "left_semi")
    return met.select(F.col("kg_node_id").alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("id"))


def ranked_from_codes(codes: DataFrame, bridges: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 20, most_anchors: int = 1000, **how) -> DataFrame:
    """id, score: personalised PageRank from the codes' anchors, of which a query may have `most_anchors`."""
    ids = [r.id for r in anchors(codes, bridges, nodes).orderBy("id").limit(most_anchors + 1).collect()]
    if len(ids) > most_anchors:
        raise ValueError(f"more than {most_anchors} anchors")
    return analytics.personalized_pagerank(edges, ids, **how).orderBy(F.desc("score"), "id").limit(top)
