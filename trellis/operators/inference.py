"""RDFS and OWL rules over triples(s, p, o_id), to the fixpoint; what is new is tagged and can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.storage import Scratch

TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
EQUIVALENT, INVERSE, TRANSITIVE, SYMMETRIC = "owl:equivalentClass", "owl:inverseOf", "owl:TransitiveProperty", "owl:SymmetricProperty"


def closure(pairs: DataFrame) -> DataFrame:
    """a, b: transitive closure, by doubling: each round joins paths with paths."""
    scratch = Scratch(pairs.sparkSession, "closure")
    all_ = scratch.table(pairs.toDF("a", "b").distinct(), "pairs")
    while True:
        longer = all_.join(all_.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))
        new = scratch.table(longer.distinct().join(all_, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            return all_
        all_ = scratch.table(all_.unionAll(new), "pairs")


def materialize(triples: DataFrame, rules: str = "rdfs") -> DataFrame:
    """s, p, o_id, inferred; rules are applied until nothing is new, which ends, as no rule makes a new name."""
    scratch = Scratch(triples.sparkSession, "inference")
    base = scratch.table(triples.select("s", "p", "o_id").distinct(), "base")
    all_ = base
    of = lambda p: all_.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o_id").alias("b"))
    kind = lambda k: all_.where((F.col("p") == TYPE) & (F.col("o_id") == k)).select(F.col("s").alias("p"))
    row = lambda df, s, p, o: df.select(F.col(s).alias("s"), (F.lit(p) if ":" in p else F.col(p)).alias("p"), F.col(o).alias("o_id"))
    while True:
        made = [row(closure(of(SUB_CLASS)), "a", SUB_CLASS, "b"), row(closure(of(SUB_PROPERTY)), "a", SUB_PROPERTY, "b")]
        typed = all_.where(F.col("p") == TYPE)
        made += [
            typed.join(of(SUB_CLASS), F.col("o_id") == F.col("a")).select("s", "p", F.col("b").alias("o_id")),
            all_.join(of(SUB_PROPERTY), F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o_id"),
            all_.join(of(DOMAIN), F.col("p") == F.col("a")).select("s", F.lit(TYPE).alias("p"), F.col("b").alias("o_id")),
            all_.join(of(RANGE), F.col("p") == F.col("a")).select(F.col("o_id").alias("s"), F.lit(TYPE).alias("p"), F.col("b").alias("o_id")),
        ]
        if rules == "owl":
            same = of(EQUIVALENT)
            both = same.union(same.select("b", "a"))
            inverse = of(INVERSE).union(of(INVERSE).select("b", "a"))
            chain = all_.join(kind(TRANSITIVE), "p", "left_semi")
            made += [
                typed.join(both, F.col("o_id") == F.col("a")).select("s", "p", F.col("b").alias("o_id")),
                all_.join(inverse, F.col("p") == F.col("a")).select(F.col("o_id").alias("s"), F.col("b").alias("p"), F.col("s").alias("o_id")),
                all_.join(kind(SYMMETRIC), "p", "left_semi").select(F.col("o_id").alias("s"), "p", F.col("s").alias("o_id")),
                chain.join(chain.select("p", F.col("s").alias("o_id"), F.col("o_id").alias("far")), ["p", "o_id"]).select("s", "p", F.col("far").alias("o_id")),
            ]
        union = made[0]
        for m in made[1:]:
            union = union.unionByName(m)
        new = scratch.table(union.distinct().join(all_, ["s", "p", "o_id"], "left_anti"), "new")
        if new.isEmpty():
            break
        all_ = scratch.table(all_.unionByName(new), "all")
    return all_.join(base.withColumn("given", F.lit(True)), ["s", "p", "o_id"], "left").select("s", "p", "o_id", F.col("given").isNull().alias("inferred"))


def retract(triples: DataFrame) -> DataFrame:
    return triples.where("NOT inferred")


def shacl(nodes: DataFrame, label: str, constraints: list[dict]) -> DataFrame:
    """focus, path, constraint of violations; nodes(node_id, labels, props). A constraint has `path` and any of min, max
    (counts; a property has as many values as `|` divides it into), datatype (a Spark type), in, pattern."""
    focus = nodes.where(F.array_contains("labels", label))
    found = None
    for c in constraints:
        v = F.col("props")[c["path"]]
        tests = {
            "min": v.isNull() if c.get("min", 0) > 0 else None, "max": F.size(F.split(v, r"\|")) > c["max"] if c.get("max") else v.isNotNull() if c.get("max") == 0 else None,
            "datatype": v.isNotNull() & v.try_cast(c["datatype"]).isNull() if "datatype" in c else None, "in": v.isNotNull() & ~v.isin(*c["in"]) if "in" in c else None, "pattern": v.isNotNull() & ~v.rlike(c["pattern"]) if "pattern" in c else None,
        }
        for name, bad in tests.items():
            if bad is not None:
                rows = focus.where(bad).select(F.col("node_id").alias("focus"), F.lit(c["path"]).alias("path"), F.lit(name).alias("constraint"))
                found = rows if found is None else found.unionAll(rows)
    return found
