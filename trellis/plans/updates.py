"""Cypher text that changes a graph: CREATE, MERGE, SET, REMOVE, DELETE, FOREACH, scripts and transactions.

A graph is never changed in place. Each statement makes a new version, whose tables are joins and unions over the old
ones; what the reading clauses bind is written to the shared folder first, so that a generated id stays what it was.

- CREATE gives a node the id of its property `id`, or one generated; relationships equal in (s, type, o) are one.
- MERGE of a node looks for its labels and properties; of a relationship, it merges the end nodes not bound yet, then
  the relationship. Rows that ask for the same missing node get one node.
- SET of one property to several values by several rows keeps the greatest; a null takes the property away.
- DELETE refuses nodes with relationships, unless DETACH is said.
- FOREACH runs its updates for each item and binds nothing outside; `IN TRANSACTIONS` makes no difference to a result.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans import cypher
from trellis.plans.graph import EdgeTable, Graph, NodeTable
from trellis.plans.planner import Planner
from trellis.storage import Scratch

#: the label of nodes created without one
UNLABELLED = "Node"


@dataclass
class Updated:
    """The new version, and what RETURN gave (None without one)."""

    graph: Graph
    df: DataFrame | None


def update(graph: Graph, text: str, params: dict | None = None) -> Updated:
    """Runs one statement or several, separated by `;`, all or none."""
    out = Updated(graph, None)
    for _, name, parts, _ in cypher.script(text):
        if name is not None:
            raise cypher.CypherError("named graphs are read only")
        out = Writer(out.graph, params or {}).run(parts[0])
    return out


@dataclass
class Session:
    """Statements over one graph; within begin .. commit they are kept or dropped together."""

    graph: Graph
    _before: list[Graph] = field(default_factory=list)

    def run(self, text: str, **params) -> DataFrame | None:
        done = update(self.graph, text, params)
        self.graph = done.graph
        return done.df

    def begin(self) -> None:
        self._before.append(self.graph)

    def commit(self) -> None:
        if not self._before:
            raise cypher.CypherError("no transaction is open")
        self._before.pop()

    def rollback(self) -> None:
        if not self._before:
            raise cypher.CypherError("no transaction is open")
        self.graph = self._before.pop()


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of either; where types differ, those of `a`."""
    kinds = dict(a.dtypes)
    return a.unionByName(b.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in b.columns)), allowMissingColumns=True)


class Writer:
    def __init__(self, graph: Graph, params: dict) -> None:
        self.g = replace(graph, nodes=dict(graph.nodes), edges=dict(graph.edges))
        self.params, self.scratch = params, Scratch(graph.spark, "updates")
        self.plan = Planner(self.g, params)
        #: labels that patterns gave to variables
        self.labels: dict[str, list[str]] = {}

    def run(self, parts: list[tuple]) -> Updated:
        self.plan.tree = parts
        done = self.clauses(parts)
        return Updated(self.g, self.plan.df if done else None)

    def clauses(self, parts: list[tuple]) -> bool:
        """Whether the last of them returns rows."""
        for clause in parts:
            kind = clause[0]
            if kind in ("match", "create", "merge"):
                for path in clause[2] if kind == "match" else clause[1]:
                    self.labels |= {e[1]: e[2] for e in path[2][::2] if e[2]}
            if kind in ("create", "merge", "set", "remove", "delete", "foreach"):
                self.rows()
                getattr(self, kind)(*clause[1:])
                if kind != "foreach":
                    self.refresh()
            elif kind == "subquery" and any(c[0] in cypher.WRITES for c in clause[1]):
                outer = self.plan.df, dict(self.plan.scope)
                self.clauses(clause[1][1:] if clause[1][0][0] == "with" else clause[1])
                self.plan.df, self.plan.scope = outer
            else:
                self.plan.clauses([clause])
        return bool(parts) and parts[-1][0] == "return"

    # --- rows that the reading clauses bound
    def rows(self) -> None:
        df = self.plan.df
        if df is None:
            df = self.g.spark.range(1).select(F.lit(1).alias("_row"))
        self.plan.df = self.scratch.table(df, "rows")

    def refresh(self) -> None:
        """Properties of bound nodes as they are now."""
        tree = self.plan.tree
        for v, kind in list(self.plan.scope.items()):
            if kind == "node":
                kept = [c for c in self.plan.df.columns if not c.startswith(f"{v}__") or c == f"{v}__id"]
                self.plan.df = self.plan.df.select(*kept)
                labels = [x for x in self.labels.get(v, []) if x in self.g.nodes]
                self.plan.tree = [tree, ("prop", ("var", v), "*")]
                scan = self.plan.node_scan(("node", v, labels, False, []))
                if scan is not None:
                    self.plan.df = self.plan.df.join(scan.withColumnRenamed(f"{v}__id", "_scanned"), F.col(f"{v}__id") == F.col("_scanned"), "left").drop("_scanned")
        self.plan.tree = tree

    def bind(self, var: str, new_id) -> None:
        self.plan.df = self.scratch.table(self.plan.df.withColumn(f"{var}__id", new_id), "rows")
        self.plan.scope[var] = "node"

    # --- changes of tables
    def add_nodes(self, label: str, rows: DataFrame) -> None:
        """rows(id, properties..), whose ids may be there already."""
        rows = rows.dropDuplicates(["id"])
        if label in self.g.nodes:
            old = self.g.nodes[label]
            own = rows.withColumnRenamed("id", old.id)
            rows = _union(old.df, own.join(old.df.select(old.id), old.id, "left_anti"))
            self.g.nodes[label] = NodeTable(rows, old.id)
        else:
            self.g.nodes[label] = NodeTable(rows)

    def add_edges(self, kind: str, rows: DataFrame) -> None:
        rows = rows.dropDuplicates(["s", "o_id"])
        if kind in self.g.edges:
            old = self.g.edges[kind]
            self.g.edges[kind] = EdgeTable(_union(old.df, rows.join(old.df.select("s", "o_id"), ["s", "o_id"], "left_anti")))
        else:
            self.g.edges[kind] = EdgeTable(rows)

    def values(self, pairs: list[tuple]) -> dict:
        return {k: self.plan.col(e) for k, e in pairs}

    # --- CREATE and MERGE
    def create(self, paths: list[tuple], _on: dict) -> None:
        for _, _, elements in paths:
            for node in elements[::2]:
                if node[1] not in self.plan.scope:
                    self.new_node(node)
            for a, rel, b in zip(elements[:-1:2], elements[1::2], elements[2::2], strict=True):
                self.new_edge(a, rel, b)

    def new_node(self, node: tuple) -> None:
        _, var, labels, _, props = node
        made = self.values(props)
        given = next((made[k] for k in ("id", "node_id") if k in made), None)
        self.bind(var, given.cast("string") if given is not None else F.concat(F.lit(f"{(labels or [UNLABELLED])[0]}:"), F.uuid()))
        rows = self.plan.df.select(F.col(f"{var}__id").alias("id"), *(c.alias(k) for k, c in self.values(props).items() if k not in ("id", "node_id")))
        for label in labels or [UNLABELLED]:
            self.add_nodes(label, rows)

    def new_edge(self, a: tuple, rel: tuple, b: tuple) -> None:
        if len(rel[2]) != 1:
            raise cypher.CypherError("a new relationship has one type")
        s, o = (a, b) if rel[3] != "in" else (b, a)
        rows = self.plan.df.select(F.col(f"{s[1]}__id").alias("s"), F.col(f"{o[1]}__id").alias("o_id"), *(c.alias(k) for k, c in self.values(rel[6]).items()))
        self.add_edges(rel[2][0], rows.where("s IS NOT NULL AND o_id IS NOT NULL"))
        self.plan.df = self.plan.df.withColumns({f"{rel[1]}__s": F.col(f"{s[1]}__id"), f"{rel[1]}__o": F.col(f"{o[1]}__id"), f"{rel[1]}__p": F.lit(rel[2][0])})
        self.plan.scope[rel[1]] = "edge"

    def merge(self, paths: list[tuple], on: dict) -> None:
        for _, _, elements in paths:
            marks = {}
            for node in elements[::2]:
                if node[1] not in self.plan.scope:
                    marks[node[1]] = self.merge_node(node)
            for a, rel, b in zip(elements[:-1:2], elements[1::2], elements[2::2], strict=True):
                known = self.edges_of(rel[2][0]).select(F.col("s").alias("_s"), F.col("o_id").alias("_o")).distinct().withColumn("_met", F.lit(True))
                s, o = (a, b) if rel[3] != "in" else (b, a)
                mark = self.plan.fresh("m")
                same = (F.col(f"{s[1]}__id") == F.col("_s")) & (F.col(f"{o[1]}__id") == F.col("_o"))
                self.plan.df = self.scratch.table(self.plan.df.join(known, same, "left").withColumn(mark, F.coalesce("_met", F.lit(False))).drop("_s", "_o", "_met"), "rows")
                marks[rel[1]] = mark
                self.new_edge(a, rel, b)
            # what the last element of the pattern was, decides between ON CREATE and ON MATCH
            mark = marks.get(elements[-2 if len(elements) > 1 else 0][1])
            if on and mark:
                for when, met in (("create", False), ("match", True)):
                    if when in on:
                        self.refresh()
                        whole, self.plan.df = self.plan.df, self.scratch.table(self.plan.df.where(F.col(mark) == met), "rows")
                        self.set(on[when])
                        self.plan.df = whole

    def edges_of(self, kind: str) -> DataFrame:
        return self.g.edges[kind].df if kind in self.g.edges else self.g.spark.createDataFrame([], "s string, o_id string")

    def merge_node(self, node: tuple) -> str:
        _, var, labels, _, props = node
        mark, keys = self.plan.fresh("m"), [(k, self.plan.fresh("k")) for k, _ in props]
        made = self.values(props)
        df = self.plan.df.withColumns({c: made[k] for k, c in keys})
        labels = labels or [UNLABELLED]
        tables = [self.g.nodes.get(x) for x in labels]
        named = lambda t, k: t.id if k in ("id", "node_id") else k
        if all(t is not None and all(named(t, k) in t.df.columns for k, _ in keys) for t in tables):
            first = tables[0]
            found = first.df.select(F.col(first.id).alias("_found"), *(F.col(named(first, k)).alias(f"_{c}") for k, c in keys))
            for t in tables[1:]:
                found = found.join(t.df.select(F.col(t.id).alias("_found")), "_found", "left_semi")
            df = df.join(found, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for _, c in keys), F.lit(True)), "left").drop(*(f"_{c}" for _, c in keys))
        else:
            df = df.withColumn("_found", F.lit(None).cast("string"))
        given = next((F.col(c).cast("string") for k, c in keys if k in ("id", "node_id")), None)
        # rows that miss the same node make the same one
        wanted = df.where("_found IS NULL").select(*(c for _, c in keys)).distinct().withColumn("_new", given if given is not None else F.concat(F.lit(f"{labels[0]}:"), F.uuid()))
        wanted = self.scratch.table(wanted, "new")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for _, c in keys), F.lit(True))
        df = df.join(wanted.withColumnsRenamed({c: f"_{c}" for _, c in keys}), same & F.col("_found").isNull(), "left")
        df = df.withColumns({mark: F.col("_found").isNotNull(), f"{var}__id": F.coalesce("_found", "_new")}).drop("_found", "_new", *(f"_{c}" for _, c in keys), *(c for _, c in keys))
        self.plan.df = self.scratch.table(df, "rows")
        self.plan.scope[var] = "node"
        for label in labels:
            self.add_nodes(label, wanted.select(F.col("_new").alias("id"), *(F.col(c).alias(k) for k, c in keys if k not in ("id", "node_id"))))
        return mark

    # --- SET, REMOVE, DELETE
    def tables_of(self, var: str) -> list[str]:
        return [x for x in self.labels.get(var, []) if x in self.g.nodes] or sorted(self.g.nodes)

    def set(self, items: list[tuple]) -> None:
        for item in items:
            if item[0] == "label":
                self.set_label(item[1], item[2])
            elif item[0] == "merge":
                if item[2][0] != "map":
                    raise cypher.CypherError("+= takes a map")
                for k, e in item[2][1]:
                    self.set_prop(item[1], k, self.plan.col(e))
            else:
                self.set_prop(item[1], item[2], self.plan.col(item[3]))

    def set_prop(self, var: str, key: str, value) -> None:
        if self.plan.scope.get(var) == "edge":
            rows = self.plan.df.select(F.col(f"{var}__s").alias("s"), F.col(f"{var}__o").alias("o_id"), F.col(f"{var}__p").alias("_p"), value.alias("_value"))
            changes = self.scratch.table(rows.groupBy("_p", "s", "o_id").agg(F.max("_value").alias("_value")), "changes")
            for (kind,) in changes.select("_p").distinct().collect():  # as many as types
                t = self.g.edges[kind]
                self.g.edges[kind] = replace(t, df=_changed(t.df, changes.where(F.col("_p") == kind).drop("_p"), ["s", "o_id"], key))
            return
        changes = self.scratch.table(self.plan.df.where(F.col(f"{var}__id").isNotNull()).groupBy(F.col(f"{var}__id").alias("_id")).agg(F.max(value).alias("_value")), "changes")
        # every table that has the property, and those of the variable's labels, which may get it
        having = {label for label, t in self.g.nodes.items() if key in t.props} | {x for x in self.labels.get(var, []) if x in self.g.nodes}
        for label in having or self.g.nodes:
            t = self.g.nodes[label]
            self.g.nodes[label] = NodeTable(_changed(t.df, changes.withColumnRenamed("_id", t.id), [t.id], key), t.id)

    def set_label(self, var: str, label: str) -> None:
        ids = self.plan.df.select(F.col(f"{var}__id").alias("id")).distinct()
        for other in self.tables_of(var):
            t = self.g.nodes[other]
            self.add_nodes(label, t.df.withColumnRenamed(t.id, "id").join(ids, "id", "left_semi"))
        self.labels[var] = [*self.labels.get(var, []), label]

    def remove(self, items: list[tuple]) -> None:
        for item in items:
            if item[0] == "label":
                t = self.g.nodes.get(item[2])
                if t is not None:
                    ids = self.plan.df.select(F.col(f"{item[1]}__id").alias(t.id)).distinct()
                    self.g.nodes[item[2]] = NodeTable(t.df.join(ids, t.id, "left_anti"), t.id)
            else:
                self.set_prop(item[1], item[2], F.lit(None).cast("string"))

    def delete(self, detach: bool, names: list[str]) -> None:
        for v in names:
            if self.plan.scope.get(v) == "edge":
                gone = self.plan.df.select(F.col(f"{v}__s").alias("s"), F.col(f"{v}__o").alias("o_id"), F.col(f"{v}__p").alias("_p")).distinct()
                for kind, t in self.g.edges.items():
                    self.g.edges[kind] = replace(t, df=t.df.join(gone.where(F.col("_p") == kind), ["s", "o_id"], "left_anti"))
        nodes = [v for v in names if self.plan.scope.get(v) == "node"]
        for v in nodes:
            ids = self.scratch.table(self.plan.df.select(F.col(f"{v}__id").alias("id")).where("id IS NOT NULL").distinct(), "gone")
            for kind, t in self.g.edges.items():
                left = t.df.join(ids.toDF("s"), "s", "left_anti").join(ids.toDF("o_id"), "o_id", "left_anti").select(*t.df.columns)
                if not detach and not t.df.join(ids.toDF("s"), "s", "left_semi").select("s").union(t.df.join(ids.toDF("o_id"), "o_id", "left_semi").select("s")).isEmpty():
                    raise cypher.CypherError(f"{v} has relationships of type {kind}; say DETACH DELETE")
                self.g.edges[kind] = replace(t, df=left)
            for label, t in self.g.nodes.items():
                self.g.nodes[label] = NodeTable(t.df.join(ids.withColumnRenamed("id", t.id), t.id, "left_anti"), t.id)
        for v in names:
            self.plan.scope.pop(v, None)

    def foreach(self, var: str, items: tuple, updates: list[tuple]) -> None:
        before = self.plan.df, dict(self.plan.scope)
        self.plan.df = self.plan.df.withColumn(var, F.explode(self.plan.col(items)))
        self.plan.scope[var] = "value"
        self.clauses(updates)
        self.plan.df, self.plan.scope = before


def _changed(df: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with `column` taken from changes(keys.., _value) where there are any."""
    kinds = dict(df.dtypes)
    both = df.join(changes.withColumn("_hit", F.lit(True)), keys, "left")
    new = F.col("_value").cast(kinds[column]) if column in kinds else F.col("_value")
    out = both.withColumn(column, F.when(F.col("_hit"), new).otherwise(F.col(column) if column in kinds else F.lit(None)))
    return out.select(*dict.fromkeys([*df.columns, column]))
