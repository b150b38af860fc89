"""Statements about the graph itself: SHOW .., EXPLAIN and PROFILE, and schema statements, which change nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_SHOW = re.compile(r"\s*SHOW\s+(\w+)", re.I)
_EXPLAIN = re.compile(r"\s*(EXPLAIN|PROFILE)\s+(.*)", re.I | re.S)
_SCHEMA = re.compile(r"\s*(CREATE|DROP)\s+(?:\w+\s+)*?(INDEX|CONSTRAINT)\b", re.I)


def asks(text: str) -> bool:
    return bool(_SHOW.match(text) or _EXPLAIN.match(text) or _SCHEMA.match(text))


def run(graph, text: str, params: dict) -> DataFrame:
    """EXPLAIN gives the plan as rows of text; CREATE or DROP of an INDEX or CONSTRAINT is accepted and has no rows, as
    files are scanned with pushed filters instead; SHOW lists what there is."""
    from trellis.functions.scalar import AGGREGATES, SCALAR
    from trellis.plans import planner
    from trellis.plans.procedures import PROCEDURES

    spark = graph.spark
    if m := _EXPLAIN.match(text):
        df = planner.run(graph, m[2], params)
        return spark.createDataFrame([(x,) for x in df._jdf.queryExecution().toString().splitlines() if x.strip()], "plan string")
    if _SCHEMA.match(text):
        return spark.createDataFrame([], "name string")
    what = _SHOW.match(text)[1].lower().rstrip("s")
    rows = {
        "database": [("trellis", "online")], "procedure": [(n, "READ") for n in sorted({*PROCEDURES, *graph.procedures})],
        "function": [(n, "aggregate" if n in AGGREGATES else "scalar") for n in sorted({*SCALAR, *AGGREGATES})],
        "indexe": [(n, i.kind) for n, i in sorted(graph.indexes.items())], "index": [(n, i.kind) for n, i in sorted(graph.indexes.items())],
        "constraint": [], "label": [(n, "label") for n in sorted(graph.nodes)], "type": [(n, "type") for n in sorted(graph.edges)],
        "user": [("spark", "admin")], "transaction": [(str(j), "job") for j in spark.sparkContext.statusTracker().getActiveJobsIds()],
    }
    if what not in rows:
        raise ValueError(f"SHOW {what} is not known")
    return spark.createDataFrame(rows[what], "name string, kind string")
