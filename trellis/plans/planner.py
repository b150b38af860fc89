"""Syntax trees to DataFrames.

Scope maps a variable to its kind; its columns are `<var>__id` and `<var>__<property>` for nodes, `<var>__s`, `__o`,
`__p`, `__<property>` for relationships, `<var>__nodes` and `__rels` for paths, and the name itself for values. Every
clause is a step on one DataFrame: hops are equi-joins, EXISTS a semi- or anti-join, OPTIONAL MATCH and correlated
subqueries one left join on the variables they share. Which join runs is left to Catalyst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.scalar import AGGREGATES, SCALAR, aggregate
from trellis.operators import paths as path_ops
from trellis.operators import traversal
from trellis.plans import cypher, joins
from trellis.plans.graph import Graph
from trellis.storage import Scratch

_FLIP = {"out": "in", "in": "out", "both": "both"}


def run(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    from trellis.plans import admin

    if admin.asks(text):
        return admin.run(graph, text, params or {})
    if cypher.is_mutation(text):
        raise cypher.CypherError("a text that changes the graph goes to Graph.update, which returns the new version")
    *before, last = cypher.script(text)
    for statement in before:  # each is planned, so that what is wrong with it shows; the last one's rows are returned
        _run_one(graph, statement, params)
    return _run_one(graph, last, params)


def _run_one(graph: Graph, statement: tuple, params: dict | None) -> DataFrame:
    _, name, parts, alls = statement
    if name is not None:
        graph = graph.named[name]
    frames = [Planner(graph, params or {}).clauses(p) for p in parts]
    out = frames[0]
    for nxt, every in zip(frames[1:], alls, strict=True):
        out = out.unionAll(nxt)
        if not every:
            out = out.distinct()
    return out


def _mentions(tree, name: str) -> bool:
    """Whether more of a node than its id is asked for."""
    if isinstance(tree, tuple):
        if tree[:1] == ("prop",) and tree[1] == ("var", name):
            return tree[2] not in ("id", "node_id")
        if tree[:1] == ("fn",) and len(tree) == 4 and ("var", name) in tree[3]:
            return tree[1] in ("labels", "properties", "keys", "vector_similarity", "vector_distance")
        if tree[:1] in (("label",), ("project",)) and tree[1] == name:
            return True
    return isinstance(tree, tuple | list | dict) and any(_mentions(x, name) for x in (tree.values() if isinstance(tree, dict) else tree))


def _variables(tree) -> set[str]:
    if isinstance(tree, tuple):
        if tree[:1] == ("var",):
            return {tree[1]}
        if tree[:1] in (("label",), ("project",)):
            return {tree[1], *_variables(tree[2])}
        if tree[:1] in (("node",), ("rel",)) and len(tree) > 4:
            return {tree[1], *_variables(tree[-1])}
    return set().union(*map(_variables, tree)) if isinstance(tree, tuple | list) else set()


def _aggregates(tree) -> bool:
    if isinstance(tree, tuple) and tree[:1] == ("fn",) and tree[1] in AGGREGATES:
        return True
    return isinstance(tree, tuple | list) and any(map(_aggregates, tree))


def _calls(tree) -> bool:
    """Patterns inside of expressions."""
    return isinstance(tree, tuple | list) and (tree[:1] in (("exists",), ("pattern",)) or any(map(_calls, tree)))


class Planner:
    def __init__(self, graph: Graph, params: dict, df: DataFrame | None = None, scope: dict[str, str] | None = None) -> None:
        self.g, self.params, self.df, self.scope, self.tree, self.n = graph, params, df, dict(scope or {}), None, 0
        self.times: str | None = None  # a column of how many matches a row stands for

    def fresh(self, what: str) -> str:
        self.n += 1
        return f"_{what}{self.n}_{id(self) % 9973}"

    # --- clauses
    def clauses(self, parts: list[tuple], keys: list[str] | None = None) -> DataFrame:
        self.tree = parts
        for clause, after in zip(parts, [*parts[1:], (None,)], strict=True):
            kind = clause[0]
            if kind == "match":
                if self.df is not None or keys or not self.counted(clause, after):
                    self.match(*clause[1:])
            elif kind in ("with", "return"):
                self.project(*clause, keys=keys)
            elif kind == "unwind":
                col = F.explode(self.col(clause[1])).alias(clause[2])
                self.df = (self.one() if self.df is None else self.df).select(*([] if self.df is None else ["*"]), col)
                self.scope[clause[2]] = "value"
            elif kind == "call":
                self.call(*clause[1:])
            elif kind == "subquery":
                self.subquery(clause[1])
        return self.df

    def one(self) -> DataFrame:
        return self.g.spark.range(1).select()

    def match(self, optional: bool, paths: list[tuple], where) -> None:
        if optional and self.df is not None:
            shared = self.columns_of(_variables([paths, where]) & {*self.scope})
            inner = Planner(self.g, self.params, self.df.select(*shared).distinct() if shared else None, {v: k for v, k in self.scope.items() if v in _variables([paths, where])})
            inner.tree, inner.n = self.tree, self.n + 1000
            inner.match(False, paths, where)
            self.left_join(inner.df, shared)
            self.scope |= inner.scope
            return
        for p in paths:
            self.path(*p)
        if where is not None:
            self.filter(where)

    def counted(self, clause: tuple, after: tuple) -> bool:
        """Matches hops whose matches are only counted without making them: variables that are not grouped by are summed
        out one at a time, so that what is joined has one row for each combination of neighbouring variables."""
        _, optional, paths, where = clause
        if optional or where is not None or after[0] not in ("with", "return"):
            return False
        _, distinct, items, order, *_ = after
        nodes, rels = [n for p in paths for n in p[2][::2]], [r for p in paths for r in p[2][1::2]]
        named = {n[1] for n in nodes}
        plain = all(p[0] is None and p[1] is None for p in paths) and all(r[4] is None for r in rels) and len(rels) > 1 and not _variables([[n[4] for n in nodes], [r[6] for r in rels]])
        counts = [e[:3] == ("fn", "count", False) and (e[3][0] == ("star",) or e[3][0][0] == "var" and e[3][0][1] in named) for e, _ in items]
        groups = [e for (e, _), c in zip(items, counts, strict=True) if not c]
        keep = _variables(groups)
        if not plain or not any(counts) or any(map(_aggregates, groups)) or ("star",) in groups or not keep <= named or _calls(groups) or any(all(x != e and e != ("var", n) for x, n in items) for e, _ in order):
            return False
        scratch, scans, parts, seen = Scratch(self.g.spark, "counted"), {}, [], set()
        for path in paths:
            on, via = path[2][::2], path[2][1::2]
            if any(a[1] == b[1] for a, b in zip(on, on[1:], strict=False)):
                return False
            for i, node in enumerate(on):
                if node[1] in seen:
                    scan = self.node_scan(("node", self.fresh("n"), *node[2:])) if node[2] or node[4] else None
                    scan = None if scan is None else scan.select(F.col(scan.columns[0]).alias(f"{node[1]}__id")).distinct()
                else:
                    hint = self.hint(via[i - 1], via[i - 1][3], end=True) if i else self.hint(via[0], via[0][3], end=False) if via else None
                    scan = self.node_scan(node, hint)
                    scans[node[1]] = scan
                    if scan is None and not via:
                        scan = self.g.node_view().select(F.col("node_id").alias(f"{node[1]}__id"))
                    scan = None if scan is None or node[1] in keep else scan.select(f"{node[1]}__id")
                    seen.add(node[1])
                if scan is not None:
                    parts.append(scan.withColumn("_m", F.lit(1).cast("long")))
            for a, rel, b in zip(on, via, on[1:], strict=False):
                parts.append(self.edge_scan(rel, rel[3]).select(F.col("_from").alias(f"{a[1]}__id"), F.col("_to").alias(f"{b[1]}__id"), F.lit(1).cast("long").alias("_m")))
        out = joins.summed([scratch.table(p, "part") for p in parts], {f"{v}__id" for v in keep}, scratch)
        for v in sorted(keep):
            if scans[v] is not None:
                out = out.join(scans[v], f"{v}__id")
        self.df, self.times = out, "_m"
        self.scope |= dict.fromkeys(keep, "node")
        return True

    def left_join(self, right: DataFrame, shared: list[str]) -> None:
        if not shared:
            self.df = self.df.join(right, F.lit(True), "left")
            return
        names = {c: self.fresh("k") for c in shared}
        right = right.withColumnsRenamed(names)
        on = reduce(lambda a, b: a & b, (self.df[c].eqNullSafe(right[k]) for c, k in names.items()))
        self.df = self.df.join(right, on, "left").drop(*names.values())

    def columns_of(self, variables: set[str]) -> list[str]:
        if self.df is None:
            return []
        return [c for c in self.df.columns if c.split("__")[0] in variables or c in variables]

    def filter(self, where: tuple) -> None:
        if where[:2] == ("bin", "AND"):
            self.filter(where[2])
            self.filter(where[3])
            return
        negated = where[0] == "not" and where[1][0] == "exists"
        if where[0] == "exists" or negated:
            inner, shared = self.exists(where[1] if negated else where)
            names = {c: self.fresh("k") for c in shared}
            right = inner.select(*shared).withColumnsRenamed(names)
            on = reduce(lambda a, b: a & b, (self.df[c] == right[k] for c, k in names.items()), F.lit(True))
            self.df = self.df.join(right, on, "left_anti" if negated else "left_semi")
            return
        self.df = self.with_patterns(where)[0].where(self.col(self.with_patterns(where, done=True)[1]))

    def exists(self, e: tuple) -> tuple[DataFrame, list[str]]:
        shared = self.columns_of(_variables(list(e[1:])) & {*self.scope})
        inner = Planner(self.g, self.params, self.df.select(*shared).distinct(), {v: self.scope[v] for v in self.scope if v in _variables(list(e[1:]))})
        inner.tree, inner.n = [self.tree, e], self.n + 1000
        inner.match(False, e[1], e[2])
        self.n += 1
        return inner.df, [c for c in shared if c.endswith("__id") or "__" not in c]

    def with_patterns(self, e, done: bool = False):
        """Joins what EXISTS and pattern comprehensions inside an expression stand for; they become plain columns."""
        if not done:
            self.rewritten = self._patterns(e)
        return self.df, self.rewritten

    def _patterns(self, e):
        if isinstance(e, list):
            return [self._patterns(x) for x in e]
        if not isinstance(e, tuple):
            return e
        if e[:1] == ("exists",):
            inner, keys = self.exists(e)
            mark = self.fresh("e")
            self.left_join(inner.select(*keys).distinct().withColumn(mark, F.lit(True)), keys)
            self.df = self.df.withColumn(mark, F.coalesce(mark, F.lit(False)))
            self.scope[mark] = "value"
            return "var", mark
        if e[:1] == ("pattern",):
            outer = _variables([e[1], e[2], e[3]]) & {*self.scope}
            shared = self.columns_of(outer)
            inner = Planner(self.g, self.params, self.df.select(*shared).distinct(), {v: self.scope[v] for v in outer})
            inner.tree, inner.n = [self.tree, e], self.n + 1000
            inner.match(False, [e[1]], e[2])
            mark, self.n = self.fresh("p"), self.n + 1
            made = inner.df.groupBy(*shared).agg(F.array_sort(F.collect_list(inner.col(e[3]))).alias(mark))
            self.left_join(made, shared)
            self.df = self.df.withColumn(mark, F.coalesce(F.col(mark), F.array().cast(self.df.schema[mark].dataType)))
            self.scope[mark] = "value"
            return "var", mark
        return tuple(self._patterns(x) for x in e)

    # --- patterns
    def node_scan(self, node: tuple, hint: str | None = None) -> DataFrame | None:
        """Rows of a node pattern; None if every id will do."""
        _, var, labels, any_, props = node
        p = f"{var}__"
        if not labels and hint and (props or _mentions(self.tree, var)):
            labels = [hint]
        if labels:
            known = [self.g.nodes[x] for x in labels if x in self.g.nodes]
            typed = [t.df.select(F.col(t.id).alias(p + "id"), *(F.col(c).alias(p + c) for c in t.props if c != "id")) for t in known]
            if not typed:
                return self.g.spark.createDataFrame([], f"`{p}id` string")
            if any_:
                out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)
            else:
                out = typed[0] if len(known) == len(labels) else typed[0].limit(0)
                for t in typed[1:]:
                    out = out.join(t.select(p + "id", *(c for c in t.columns if c not in out.columns)), p + "id")
        elif props or _mentions(self.tree, var):
            out = self.g.node_view().select(F.col("node_id").alias(p + "id"), F.col("labels").alias(p + "labels"), F.col("props").alias(p + "props"))
        else:
            return None
        inner = Planner(self.g, self.params, out, {var: "node"})
        return reduce(lambda d, kv: d.where(inner.col(("bin", "=", ("prop", ("var", var), kv[0]), kv[1]))), props, out)

    def edge_scan(self, rel: tuple, direction: str) -> DataFrame:
        """Columns _from, _to and those of the relationship, in the direction of travel."""
        _, var, types, _, _, _, props = rel
        p, made = f"{var}__", []
        for kind in types or sorted(self.g.edges):
            if kind in self.g.edges:
                t = self.g.edges[kind]
                made.append(t.df.select(F.col("s").alias(p + "s"), F.col("o_id").alias(p + "o"), F.lit(kind).alias(p + "p"), *(F.col(c).alias(p + c) for c in t.props)))
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made) if made else self.g.spark.createDataFrame([], f"`{p}s` string, `{p}o` string, `{p}p` string")
        inner = Planner(self.g, self.params, out, {var: "edge"})
        out = reduce(lambda d, kv: d.where(inner.col(("bin", "=", ("prop", ("var", var), kv[0]), kv[1]))), props, out)
        ahead = out.withColumns({"_from": F.col(p + "s"), "_to": F.col(p + "o")})
        back = out.withColumns({"_from": F.col(p + "o"), "_to": F.col(p + "s")})
        return {"out": ahead, "in": back}.get(direction) if direction != "both" else ahead.unionAll(back)

    def hint(self, rel: tuple | None, direction: str, end: bool) -> str | None:
        """The label that a single mapped type implies for the node where a hop begins or ends."""
        if rel is None or len(rel[2]) != 1 or rel[2][0] not in self.g.edges or direction == "both":
            return None
        t = self.g.edges[rel[2][0]]
        return t.target if (direction == "out") == end else t.source

    def join_in(self, right: DataFrame) -> None:
        self.df = right if self.df is None else self.df.crossJoin(right)

    def path(self, name: str | None, kind: str | None, elements: list[tuple]) -> None:
        nodes, rels = elements[::2], [(r, r[3]) for r in elements[1::2]]
        if nodes[0][1] not in self.scope and nodes[-1][1] in self.scope and kind is None and len(nodes) > 1:
            nodes, rels = nodes[::-1], [(r, _FLIP[d]) for r, d in rels[::-1]]
        if kind is not None:
            self.shortest(name, kind, nodes, rels[0][0])
            return
        first, start = nodes[0], None
        if first[1] not in self.scope:
            start = self.node_scan(first, self.hint(*(rels[0] if rels else (None, "both")), end=False))
            if start is not None:
                self.join_in(start)
            elif not rels:
                self.join_in(self.g.node_view().select(F.col("node_id").alias(f"{first[1]}__id")))
        elif first[2] or first[4]:
            self.narrow(first)
        bound = first[1] in self.scope or start is not None or not rels
        self.scope[first[1]] = "node"
        back = None
        if len(rels) > 3 and nodes[-1][1] == first[1] and name is None and bound:  # a cycle: both ways, to meet in the middle
            h = len(rels) // 2
            back, nodes, rels = (nodes[h:][::-1], [(r, _FLIP[d]) for r, d in rels[h:][::-1]]), nodes[: h + 1], rels[:h]
        for (rel, direction), node in zip(rels, nodes[1:], strict=True):
            self.hop(first, rel, direction, node, bound)
            first, bound = node, True
        if back:
            self.meet(*back)
        if name:
            ids = [F.col(f"{n[1]}__id") for n in nodes]
            self.df = self.df.withColumns({f"{name}__nodes": F.array(*ids), f"{name}__rels": F.array(*(F.col(f"{r[1]}__p") for r, _ in rels)) if rels else F.array().cast("array<string>")})
            self.scope[name] = "path"

    def meet(self, nodes: list[tuple], rels: list[tuple]) -> None:
        """Joins a path between two bound nodes as a whole, from its first node, rather than hop by hop."""
        start, end = (f"{n[1]}__id" for n in (nodes[0], nodes[-1]))
        inner = Planner(self.g, self.params, self.df.select(start).distinct(), {nodes[0][1]: "node"})
        inner.tree, inner.n, at = self.tree, self.n + 1000, nodes[0]
        for (rel, direction), node in zip(rels, nodes[1:], strict=True):
            inner.hop(at, rel, direction, node, True)
            at = node
        keys = {c: self.fresh("k") for c in (start, end)}
        other = inner.df.select(*keys, *(c for c in inner.df.columns if c not in self.df.columns)).withColumnsRenamed(keys)
        self.df = self.df.join(other, reduce(lambda a, b: a & b, (F.col(c) == F.col(k) for c, k in keys.items()))).drop(*keys.values())
        self.scope |= inner.scope

    def narrow(self, node: tuple) -> None:
        """Labels and properties asked of a variable that is bound already."""
        other = ("node", self.fresh("n"), *node[2:])
        scan = self.node_scan(other).select(F.col(f"{other[1]}__id"))
        self.df = self.df.join(scan, F.col(f"{node[1]}__id") == F.col(f"{other[1]}__id"), "left_semi")

    def hop(self, a: tuple, rel: tuple, direction: str, b: tuple, bound: bool) -> None:
        a_id, b_id = f"{a[1]}__id", f"{b[1]}__id"
        if rel[4] is not None:
            self.reach(a, rel, direction, b)
        else:
            edges = self.edge_scan(rel, direction)
            if not bound:
                self.join_in(edges.withColumnRenamed("_from", a_id))
            else:
                self.df = self.df.join(edges, F.col(a_id) == F.col("_from")).drop("_from")
            self.scope[rel[1]] = "edge"
        if b[1] in self.scope:
            self.df = self.df.where(F.col(b_id) == F.col("_to")).drop("_to")
            if b[2] or b[4]:
                self.narrow(b)
            return
        scan = self.node_scan(b, self.hint(rel, direction, end=True) if rel[4] is None else None)
        self.df = self.df.withColumnRenamed("_to", b_id) if scan is None else self.df.join(scan, F.col("_to") == F.col(b_id)).drop("_to")
        self.scope[b[1]] = "node"

    def reach(self, a: tuple, rel: tuple, direction: str, b: tuple) -> None:
        edges = self.edge_scan(rel, "out").select(F.col("_from").alias("s"), F.col("_to").alias("o_id"))
        seeds = self.df.select(F.col(f"{a[1]}__id").alias("src")).distinct()
        got = traversal.reach(edges, seeds, rel[4], rel[5], direction)
        hop, src = f"{rel[1]}__hop", self.fresh("s")
        self.df = self.df.join(got.select(F.col("src").alias(src), F.col("node").alias("_to"), F.col("hop").alias(hop)), F.col(f"{a[1]}__id") == F.col(src)).drop(src)
        self.df = self.df.withColumn(f"{rel[1]}__p", F.lit("|".join(rel[2])))
        self.scope[rel[1]] = "edge"

    def shortest(self, name: str | None, kind: str, nodes: list[tuple], rel: tuple) -> None:
        for n in (nodes[0], nodes[-1]):
            if n[1] not in self.scope:
                self.join_in(self.node_scan(n))
                self.scope[n[1]] = "node"
        a, b = (f"{n[1]}__id" for n in (nodes[0], nodes[-1]))
        edges = self.edge_scan(rel, "out").select(F.col("_from").alias("s"), F.col(f"{rel[1]}__p").alias("p"), F.col("_to").alias("o_id"))
        got = path_ops.shortest(edges, self.df.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), rel[5] or 5, rel[3], every=kind == "all")
        name = name or self.fresh("path")
        got = got.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("nodes").alias(f"{name}__nodes"), F.col("rels").alias(f"{name}__rels"))
        self.df = self.df.join(got, (F.col(a) == F.col("_src")) & (F.col(b) == F.col("_dst"))).drop("_src", "_dst")
        self.scope[name] = "path"

    # --- procedures and subqueries
    def call(self, name: str, args: list[tuple], yields: list[tuple[str, str]], where) -> None:
        from trellis.plans.procedures import PROCEDURES

        made = (self.g.procedures.get(name.lower()) or PROCEDURES[name.lower()])(self.g, *(self.value(a) for a in args))
        picked = yields or [(c, c) for c in made.columns]
        cols = [F.col(a).alias(f"{b}__id" if a == "node" else b) for a, b in picked]
        self.join_in(made.select(*cols))
        self.scope |= {b: "node" if a == "node" else "value" for a, b in picked}
        if where is not None:
            self.filter(where)

    def value(self, e: tuple):
        """A constant argument."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        if e[0] == "list":
            return [self.value(x) for x in e[1]]
        if e[0] == "map":
            return {k: self.value(x) for k, x in e[1]}
        if e[0] == "neg":
            return -self.value(e[1])
        raise cypher.CypherError("arguments of procedures are constants")

    def subquery(self, parts: list[tuple]) -> None:
        imported = [i[0][1] for i in parts[0][2]] if parts[0][0] == "with" and all(i[0][0] == "var" and i[0][1] in self.scope for i in parts[0][2]) else []
        inner = Planner(self.g, self.params)
        if not imported:
            made = inner.clauses(parts)
            self.join_in(made)
            self.scope |= dict.fromkeys(made.columns, "value")
            return
        keys = self.columns_of({*imported})
        inner.df, inner.scope, inner.n = self.df.select(*keys).distinct(), {v: self.scope[v] for v in imported}, self.n + 1000
        inner.clauses(parts[1:], keys)
        items = parts[-1][2]
        if len(items) == 1 and _aggregates(items[0][0]):
            out = items[0][1]
            self.left_join(inner.df, keys)
            if items[0][0][1] in ("count", "sum"):
                self.df = self.df.withColumn(out, F.coalesce(F.col(out), F.lit(0)))
        else:
            names = {c: self.fresh("k") for c in keys}
            right = inner.df.withColumnsRenamed(names)
            self.df = self.df.join(right, reduce(lambda a, b: a & b, (self.df[c] == right[k] for c, k in names.items()))).drop(*names.values())
        self.scope |= {n: inner.scope.get(n, "value") for _, n in items}

    # --- projection
    def project(self, kind: str, distinct: bool, items: list, order: list, skip, limit, where, keys: list[str] | None = None) -> None:
        if self.df is None:
            self.df = self.one()
        last = kind == "return" and keys is None
        items = [x for e, n in items for x in ([(("var", v), v) for v in self.scope if not v.startswith("_")] if e == ("star",) else [(e, n)])]
        items = [(self._patterns(e), n) for e, n in items]
        grouped, groups, made, scope = any(_aggregates(e) for e, _ in items), [], [], {}
        if last:
            self.expand([e[1] for e, n in items if e[0] == "var" and self.scope.get(e[1]) == "node"])
        for e, n in items:
            var = e[1] if e[0] == "var" else None
            k = self.scope.get(var) if var else None
            if k in ("node", "edge", "path"):
                cols = self.shown(var, n, k) if last else [F.col(f"`{c}`").alias(n + c[len(var) :]) for c in self.df.columns if c.startswith(f"{var}__")]
                groups += cols
                scope[n] = k
            elif _aggregates(e):
                made.append(self.col(e).alias(n))
                scope[n] = "value"
            else:
                groups.append(self.col(e).alias(n))
                scope[n] = "value"
        extra, sorts = [], []
        for e, up in order:
            same = next((n for x, n in items if x == e or e == ("var", n)), None)
            if same is None:
                same = self.fresh("o")
                (made if _aggregates(e) else groups).append(self.col(e).alias(same))
                extra.append(same)
            elif scope.get(same) == "node":
                same = f"{same}_id" if last else f"{same}__id"
            sorts.append(F.col(f"`{same}`").asc_nulls_last() if up else F.col(f"`{same}`").desc_nulls_first())
        if grouped:
            own = [F.col(k) for k in keys or []]
            self.df, self.times = self.df.groupBy(*own, *groups).agg(*made), None
        else:
            self.df = self.df.select(*(keys or []), *groups)
        self.scope = scope | ({} if keys is None else {})
        if distinct:
            self.df = self.df.distinct()
        if sorts:
            self.df = self.df.orderBy(*sorts)
        if skip is not None:
            self.df = self.df.offset(int(self.value(skip)))
        if limit is not None:
            self.df = self.df.limit(int(self.value(limit)))
        self.df = self.df.drop(*extra)
        if where is not None:
            self.filter(where)

    def expand(self, variables: list[str]) -> None:
        """Labels and properties of nodes that are returned as such."""
        for v in dict.fromkeys(variables):
            view = self.g.node_view().select(F.col("node_id").alias(f"{v}__key"), F.col("labels").alias(f"{v}__l"), F.col("props").alias(f"{v}__m"))
            self.df = self.df.join(view, F.col(f"{v}__id") == F.col(f"{v}__key"), "left").drop(f"{v}__key")

    def shown(self, v: str, n: str, kind: str) -> list[Column]:
        if kind == "node":
            return [F.col(f"{v}__id").alias(f"{n}_id"), F.col(f"{v}__l").alias(f"{n}_labels"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(f"{v}__m", lambda k, x: x.isNotNull()))))).alias(f"{n}_props")]
        if kind == "edge":
            return [F.col(f"{v}__p").alias(n)]
        return [F.to_json(F.struct(F.col(f"{v}__nodes").alias("nodes"), F.col(f"{v}__rels").alias("rels"), (F.size(f"{v}__nodes") - 1).alias("length"))).alias(n)]

    # --- expressions
    def prop(self, var: str, key: str) -> Column:
        columns = {*self.df.columns} if self.df is not None else set()
        if f"{var}__{key}" in columns:
            return F.col(f"`{var}__{key}`")
        if key in ("id", "node_id"):
            return F.col(f"{var}__id")
        if f"{var}__props" in columns:
            return F.col(f"{var}__props")[key]
        return F.lit(None).cast("string")

    def stringly(self, e: tuple) -> bool:
        return e[0] == "prop" and e[1][0] == "var" and f"{e[1][1]}__props" in self.df.columns and f"{e[1][1]}__{e[2]}" not in self.df.columns

    def col(self, e: tuple, local: dict[str, Column] | None = None) -> Column:  # noqa: C901
        c = lambda x: self.col(x, local)
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            v = self.params[e[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
        if kind == "var":
            if local and e[1] in local:
                return local[e[1]]
            k = self.scope.get(e[1])
            if k is None:
                raise cypher.CypherError(f"{e[1]} is not defined")
            return F.col(f"{e[1]}__id") if k == "node" else F.col(f"{e[1]}__p") if k == "edge" else F.size(f"{e[1]}__nodes") - 1 if k == "path" else F.col(f"`{e[1]}`")
        if kind == "prop":
            if e[1][0] == "var" and self.scope.get(e[1][1]) in ("node", "edge") and not (local and e[1][1] in local):
                return self.prop(e[1][1], e[2])
            return c(e[1]).getField(e[2])
        if kind == "bin":
            return self.binary(e, c)
        if kind == "not":
            return ~c(e[1])
        if kind == "neg":
            return -c(e[1])
        if kind == "null":
            return c(e[1]).isNotNull() if e[2] else c(e[1]).isNull()
        if kind == "label":
            have = F.col(f"{e[1]}__labels") if f"{e[1]}__labels" in self.df.columns else None
            if have is None:
                return F.lit(all(x in self.known_labels(e[1]) for x in e[2]))
            return reduce(lambda a, b: a & b, (F.array_contains(have, x) for x in e[2]))
        if kind == "case":
            tests = [(c(w) if e[1] is None else c(e[1]) == c(w), c(t)) for w, t in e[2]]
            out = reduce(lambda a, wt: a.when(*wt), tests[1:], F.when(*tests[0]))
            return out.otherwise(c(e[3])) if e[3] is not None else out
        if kind == "list":
            return F.array(*map(c, e[1]))
        if kind == "map":
            return F.struct(*(c(v).alias(k) for k, v in e[1]))
        if kind == "project":
            keys = [x for k, v in e[2] for x in ([(p, None) for p in self.props_of(e[1])] if k == "*" else [(k, v)])]
            return F.to_json(F.struct(*((self.prop(e[1], k) if v is None else c(v)).alias(k) for k, v in keys)))
        if kind == "index":
            i = c(e[2])
            return F.try_element_at(c(e[1]), F.when(i < 0, i).otherwise(i + 1).cast("int"))
        if kind == "slice":
            items = c(e[1])
            low = F.lit(0) if e[2] is None else c(e[2])
            high = F.size(items) if e[3] is None else c(e[3])
            return F.slice(items, low.cast("int") + 1, F.greatest(F.lit(0), (high - low).cast("int")))
        if kind == "comp":
            items = c(e[2])
            if e[3] is not None:
                items = F.filter(items, lambda x: self.col(e[3], {**(local or {}), e[1]: x}))
            return items if e[4] is None else F.transform(items, lambda x: self.col(e[4], {**(local or {}), e[1]: x}))
        if kind == "quant":
            test = lambda x: self.col(e[4], {**(local or {}), e[2]: x})
            items = c(e[3])
            return {"any": lambda: F.exists(items, test), "all": lambda: F.forall(items, test), "none": lambda: ~F.exists(items, test), "single": lambda: F.size(F.filter(items, test)) == 1}[e[1]]()
        if kind == "reduce":
            start, items = c(e[2]).cast("double"), c(e[4])
            return F.aggregate(items, start, lambda a, x: self.col(e[5], {**(local or {}), e[1]: a, e[3]: x}).cast("double"))
        if kind == "fn":
            return self.function(e, c, local)
        raise cypher.CypherError(f"no expression: {kind}")

    def known_labels(self, var: str) -> set[str]:
        found: set[str] = set()

        def walk(t) -> None:
            if isinstance(t, tuple) and t[:1] == ("node",) and len(t) == 5 and t[1] == var:
                found.update(t[2])
            if isinstance(t, tuple | list):
                for x in t:
                    walk(x)

        walk(self.tree)
        return found

    def props_of(self, var: str) -> list[str]:
        return [c[len(var) + 2 :] for c in self.df.columns if c.startswith(f"{var}__") and c not in (f"{var}__id", f"{var}__labels", f"{var}__props")]

    def binary(self, e: tuple, c) -> Column:
        _, op, x, y = e
        a, b = c(x), c(y)
        if op in ("<", "<=", ">", ">=") and (self.df is not None and (self.stringly(x) or self.stringly(y))):
            a, b = a.try_cast("double"), b.try_cast("double")
        if op in ("=", "<>") and self.df is not None and (self.stringly(x) or self.stringly(y)):
            a, b = a.cast("string"), b.cast("string")
        if op == "+" and any(z[0] == "lit" and isinstance(z[1], str) for z in (x, y)):
            return F.concat(a.cast("string"), b.cast("string"))
        if op == "IN":
            if y[0] == "list":
                return a.isin(*(self.value(z) for z in y[1])) if y[1] else F.lit(False)
            if y[0] == "param":
                v = list(self.params[y[1]])
                return a.isin(*v) if v else F.lit(False)
            return F.array_contains(b, a)
        return {
            "AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: (a & ~b) | (~a & b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "^": lambda: F.pow(a, b),
            "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "CONTAINS": lambda: F.contains(a, b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }[op]()

    def function(self, e: tuple, c, local) -> Column:
        _, name, distinct, args = e
        last = name.split(".")[-1]  # a namespace before a function that is known here says nothing more
        name = last if name not in SCALAR and (last in SCALAR or last in AGGREGATES) else name
        first = args[0] if args else None
        var = first[1] if first and first[0] == "var" and not (local and first[1] in local) else None
        kind = self.scope.get(var) if var else None
        if name == "count" and self.times:
            return F.coalesce(F.sum(self.times), F.lit(0)).cast("long")
        if name in AGGREGATES:
            return aggregate(name, distinct, [] if first == ("star",) else [c(a) for a in args])
        if kind == "path":
            return {"length": F.size(f"{var}__nodes") - 1, "nodes": F.col(f"{var}__nodes"), "relationships": F.col(f"{var}__rels")}[name]
        if kind in ("node", "edge"):
            if name in ("id", "elementid"):
                return F.col(f"{var}__id")
            if name == "labels":
                return F.col(f"{var}__labels") if f"{var}__labels" in self.df.columns else F.array(*map(F.lit, sorted(self.known_labels(var))))
            if name == "type":
                return F.col(f"{var}__p")
            if name in ("startnode", "endnode"):
                return F.col(f"{var}__{'s' if name == 'startnode' else 'o'}")
            if name in ("keys", "properties"):
                have = f"{var}__props" in self.df.columns
                if name == "keys":
                    return F.array_sort(F.map_keys(f"{var}__props")) if have else F.array_sort(F.array(*map(F.lit, self.props_of(var))))
                return F.col(f"{var}__props") if have else F.to_json(F.struct(*(self.prop(var, p).alias(p) for p in self.props_of(var))))
        if name == "exists":
            return c(first).isNotNull()
        if name in ("size", "length", "isempty"):
            x = c(first)
            listed = first[0] in ("list", "comp", "slice", "pattern") or first[0] == "fn" and first[1] in ("collect", "split", "range", "tail", "keys", "labels") or first[0] == "var" and var and self.df is not None and var in self.df.columns and self.df.schema[var].dataType.typeName() == "array"
            n = F.size(x) if listed else F.char_length(x)
            return n == 0 if name == "isempty" else n
        if name in SCALAR:
            return SCALAR[name](*(c(a) for a in args))
        return F.call_function(name, *(c(a) for a in args))
