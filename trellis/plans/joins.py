"""Counts of the rows of a join of many tables, without making these rows."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.storage import Scratch


class _Table:
    """A DataFrame with `_m`, how often each row counts, and estimates of rows and of different values by column."""

    def __init__(self, df: DataFrame, rows: float | None = None, kinds: dict[str, float] | None = None) -> None:
        self.df, self.on = df, [c for c in df.columns if c != "_m"]
        if kinds is None:
            got = df.agg(F.count("*").alias("_rows"), *(F.approx_count_distinct(c).alias(c) for c in self.on)).first()
            rows, kinds = got["_rows"], {c: max(1, got[c]) for c in self.on}
        self.rows, self.kinds = rows, kinds

    def joined(self, other: _Table) -> _Table:
        both = [c for c in self.on if c in other.on]
        right = other.df.withColumnRenamed("_m", "_k")
        df = (self.df.join(right, both) if both else self.df.crossJoin(right)).withColumn("_m", F.col("_m") * F.col("_k")).drop("_k")
        return _Table(df, self.size(other), {c: min(x.kinds[c] for x in (self, other) if c in x.kinds) for c in {*self.on, *other.on}})

    def size(self, other: _Table) -> float:
        return self.rows * other.rows / prod(max(self.kinds[c], other.kinds[c]) for c in self.on if c in other.on)

    def without(self, column: str) -> _Table:
        left = [c for c in self.on if c != column]
        return _Table(self.df.groupBy(*left).agg(F.sum("_m").alias("_m")).where("_m IS NOT NULL"), min(self.rows, prod(self.kinds[c] for c in left)), {c: self.kinds[c] for c in left})


def _all(tables: list[_Table]) -> tuple[float, list[_Table]]:
    """An order that joins the least first, and the most rows that it makes."""
    left, worst = list(tables), 0.0
    at = min(left, key=lambda t: t.rows)
    if len(left) > 1:
        at = min(((a.size(b), i, a) for i, a in enumerate(left) for b in left if a is not b), key=lambda x: x[:2])[2]
    order = [at]
    left.remove(at)
    worst, rows, kinds = at.rows, at.rows, dict(at.kinds)
    while left:
        size = lambda t: rows * t.rows / prod(max(kinds[c], t.kinds[c]) for c in t.on if c in kinds)  # noqa: B023, E731
        at = min(left, key=size)
        rows = size(at)
        kinds = {c: min(x[c] for x in (kinds, at.kinds) if c in x) for c in {*kinds, *at.kinds}}
        worst = max(worst, rows)
        order.append(at)
        left.remove(at)
    return worst, order


def summed(tables: list[DataFrame], keep: set[str], scratch: Scratch) -> DataFrame:
    """The natural join of tables with a column `_m`, grouped by `keep`, with the sum of the products of `_m`.

    Columns that are not kept are summed out one at a time, the one first whose tables make the fewest rows together. Tables
    that have none but the columns of such a join are joined to it too, since they can only make it smaller."""
    have = [_Table(t) for t in tables]
    while gone := {c for t in have for c in t.on} - keep:
        plans = []
        for c in sorted(gone):
            scope = {x for t in have if c in t.on for x in t.on}
            plans.append((*_all([t for t in have if c in t.on or (t.on and {*t.on} <= scope)]), c))
        _, order, c = min(plans, key=lambda p: (p[0], p[2]))
        one = reduce(_Table.joined, order).without(c)
        have = [t for t in have if not any(t is o for o in order)] + [_Table(scratch.table(one.df, "summed"))]
    return reduce(_Table.joined, _all(have)[1]).df.groupBy(*sorted(keep)).agg(F.sum("_m").alias("_m")).where("_m IS NOT NULL")
