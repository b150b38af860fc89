"""GraphQL reads over a graph: selections become joins, and each root field one row set.

    { Nation(where: {n_nationkey: 3}, limit: 5, orderBy: "n_name") { id n_name out(type: "IN_REGION") { id r_name } } }

A root field is a label, `nodes` (any label), `cypher(query: "..")` or `semanticSearch(index: "..", vector: [..], limit: k)`.
Fields are properties, `id`, `labels`; `out` and `in` are lists of neighbours by a type, with fields of their own, in order
of id. Mutations are not taken: a graph changes by `Graph.update`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans.graph import Graph

_TOKEN = re.compile(r'\s+|,|#[^\n]*|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<var>\$\w+)|(?P<op>[{}():\[\]!=])')


class GraphQLError(ValueError):
    pass


@dataclass
class Field:
    name: str
    alias: str
    args: dict = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str, variables: dict) -> None:
        self.t, self.i, self.variables, at = [], 0, variables, 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise GraphQLError(f"unexpected {text[at]!r}")
            at = m.end()
            if m.lastgroup:
                self.t.append((m.lastgroup, m[0]))
        self.t.append(("end", ""))

    def take(self, value: str) -> bool:
        if self.t[self.i][1] == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise GraphQLError(f"expected {value}, found {self.t[self.i][1]!r}")

    def document(self) -> list[Field]:
        kind = self.t[self.i][1]
        if kind in ("mutation", "subscription"):
            raise GraphQLError(f"a {kind} is not taken")
        if kind == "query":
            self.i += 1
            while not self.t[self.i][1] == "{":
                if self.take("("):
                    while not self.take(")"):
                        self.i += 1
                else:
                    self.i += 1
        return self.selection()

    def selection(self) -> list[Field]:
        self.need("{")
        out = []
        while not self.take("}"):
            kind, name = self.t[self.i]
            if kind != "name":
                raise GraphQLError(f"expected a field, found {name!r}")
            self.i += 1
            alias = name
            if self.take(":"):
                name = self.t[self.i][1]
                self.i += 1
            args = {}
            if self.take("("):
                while not self.take(")"):
                    key = self.t[self.i][1]
                    self.i += 1
                    self.need(":")
                    args[key] = self.value()
            out.append(Field(name, alias, args, self.selection() if self.t[self.i][1] == "{" else []))
        return out

    def value(self):
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "num":
            return float(text) if "." in text else int(text)
        if kind == "var":
            return self.variables[text[1:]]
        if text == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if text == "{":
            found = {}
            while not self.take("}"):
                key = self.t[self.i][1]
                self.i += 1
                self.need(":")
                found[key] = self.value()
            return found
        return {"true": True, "false": False, "null": None}.get(text, text)


def query(graph: Graph, text: str, **variables) -> dict[str, DataFrame]:
    """A DataFrame for each root field, by its alias."""
    return {f.alias: _root(graph, f) for f in _Reader(text, variables).document()}


def schema(graph: Graph) -> str:
    """The types that labels make."""
    of = {"bigint": "Int", "int": "Int", "double": "Float", "float": "Float", "boolean": "Boolean"}
    types = []
    for label, t in sorted(graph.nodes.items()):
        rows = [f"  {c}: {of.get(k, 'String')}" for c, k in t.df.dtypes if c != t.id]
        types.append("\n".join([f"type {label} {{", "  id: ID!", *rows, f"  out(type: String): [{label}Neighbor]", "}"]))
    return "\n".join(types)


def _root(graph: Graph, f: Field) -> DataFrame:
    if f.name == "cypher":
        return graph.cypher(f.args["query"], **f.args.get("parameters", {}))
    if f.name == "semanticSearch":
        from trellis.operators.indexes import index

        hits = index(graph, f.args["index"]).search(f.args["vector"], f.args.get("limit", 10))
        return hits.select(F.col("id").cast("string").alias("id"), "score")
    rows = _label(graph, f.name)
    for key, want in f.args.get("where", {}).items():
        rows = rows.where(F.col(key).isNull() if want is None else F.col(key).isin(*want) if isinstance(want, list) else F.col(key) == F.lit(want))
    if "orderBy" in f.args:
        rows = rows.orderBy(F.col(f.args["orderBy"]).asc_nulls_last(), "id")
    if "limit" in f.args:
        rows = (rows if "orderBy" in f.args else rows.orderBy("id")).limit(f.args["limit"])
    return _with_neighbours(graph, rows, f).drop("_id")


def _label(graph: Graph, name: str) -> DataFrame:
    if name == "nodes":
        return graph.node_view().select(F.col("node_id").alias("id"), "labels", "props")
    if name not in graph.nodes:
        raise GraphQLError(f"there is no {name!r}")
    t = graph.nodes[name]
    return t.df.select(F.col(t.id).alias("id"), *(c for c in t.props if c != "id"), F.array(F.lit(name)).alias("labels"))


def _edges(f: Field) -> list[Field]:
    return [x for x in f.fields if x.name in ("out", "in")]


def _shown(f: Field, rows: DataFrame):
    """The plain fields as one struct r."""
    def one(x: Field):
        if x.name in rows.columns:
            return F.col(x.name).alias(x.alias)
        if "props" in rows.columns:
            return F.col("props")[x.name].alias(x.alias)
        raise GraphQLError(f"there is no field {x.name!r}")

    plain = [one(x) for x in f.fields if not x.fields and x.name not in ("out", "in")]
    return F.struct(*(plain or [F.col("id")])).alias("r")


def _with_neighbours(graph: Graph, rows: DataFrame, f: Field) -> DataFrame:
    """Plain fields, and one list of structs for each `out` or `in`."""
    base = rows.select(F.col("id").alias("_id"), _shown(f, rows))
    for x in _edges(f):
        e = graph.edge_view([x.args["type"]] if "type" in x.args else None)
        ends = ("s", "o_id") if x.name == "out" else ("o_id", "s")
        e = e.select(F.col(ends[0]).alias("_from"), F.col(ends[1]).alias("_to")).distinct()
        kind = x.args.get("label")
        if kind is None and "type" in x.args and x.args["type"] in graph.edges:
            t = graph.edges[x.args["type"]]
            kind = t.target if x.name == "out" else t.source
        far = _label(graph, kind or "nodes")
        inner = _with_neighbours(graph, far, x) if _edges(x) else far.select(F.col("id").alias("_id"), _shown(x, far))
        made = inner.select("_id", "r") if "r" in inner.columns else inner.select("_id", F.struct(*(c for c in inner.columns if c != "_id")).alias("r"))
        lists = e.join(made.withColumnRenamed("_id", "_to"), "_to").groupBy("_from").agg(F.array_sort(F.collect_list(F.struct("_to", "r"))).alias("l"))
        base = base.join(lists.select(F.col("_from").alias("_id"), F.transform("l", lambda v: v["r"]).alias(f"_l_{x.alias}")), "_id", "left")
    return base.select("_id", "r.*", *(F.col(f"_l_{x.alias}").alias(x.alias) for x in _edges(f)))
