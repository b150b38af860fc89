"""Rows of two engines in one form."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return str(sorted((str(a), plain(b)) for a, b in v.items()))
    return str(v)


def of_spark(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in (x.asDict(recursive=True) for x in df.collect()))


def of_duck(con, sql: str) -> tuple[list[str], list]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in got.fetchall())
