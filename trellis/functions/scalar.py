"""Cypher's scalar, list and aggregate functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentiledisc", "percentilecont", "approx_count_distinct"}


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(s, start.cast("int") + 1, F.length(s) if length is None else length.cast("int"))


def _bool(x: Column) -> Column:
    t = F.lower(x.cast("string"))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


SCALAR = {
    "tolower": F.lower, "toupper": F.upper, "lower": F.lower, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "substring": _substring, "left": lambda s, n: F.substring(s, F.lit(1), n.cast("int")), "right": lambda s, n: F.right(s, n),
    "replace": F.replace, "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), F.lit(-1)), "reverse": F.reverse,
    "tointeger": lambda x: x.try_cast("double").cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": _bool,
    "coalesce": F.coalesce, "nullif": F.nullif,
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x, d=None: F.round(x, d) if d is not None else F.round(x), "sqrt": F.sqrt,
    "sign": lambda x: F.signum(x).cast("int"), "rand": F.rand, "e": lambda: F.exp(F.lit(1.0)), "pi": lambda: F.lit(3.141592653589793), "exp": F.exp, "log": F.log, "log10": F.log10,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "pow": F.pow, "haversin": lambda x: (1 - F.cos(x)) / 2, "degrees": F.degrees, "radians": F.radians,
    "timestamp": lambda: F.unix_millis(F.current_timestamp()), "datetime": lambda x=None: F.current_timestamp() if x is None else F.to_timestamp(x), "localdatetime": lambda x=None: F.current_timestamp() if x is None else F.to_timestamp(x),
    "date": lambda x=None: F.current_date() if x is None else F.to_date(x), "time": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"), "localtime": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"), "duration": lambda x: x.cast("string"),
    "randomuuid": F.uuid, "head": lambda x: F.try_element_at(x, F.lit(1)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "tail": lambda x: F.slice(x, 2, F.greatest(F.lit(0), F.size(x) - 1)),
    "range": lambda a, b, s=None: F.sequence(a, b) if s is None else F.sequence(a, b, s),
    "json_arraylength": F.json_array_length, "json_value": F.get_json_object, "json_arrayget": lambda j, i: F.get_json_object(j, F.concat(F.lit("$["), i.cast("string"), F.lit("]"))),
    "vector_similarity": lambda a, b: cosine(a, b), "vector_distance": lambda a, b: 1 - cosine(a, b),
}


def aggregate(name: str, distinct: bool, args: list[Column]) -> Column:
    x = args[0] if args else None
    if name == "count":
        return F.count_distinct(x) if distinct else F.count("*" if x is None else x)
    if name == "sum":
        return F.sum_distinct(x) if distinct else F.sum(x)
    if name == "avg":
        return F.mean(x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
    if name == "collect":
        return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
    if name == "percentilecont":
        return F.percentile(x, args[1])
    if name == "percentiledisc":  # the least value with at least that share of values up to it
        ordered = F.array_sort(F.collect_list(x))
        return F.element_at(ordered, F.greatest(F.lit(1), F.ceil(args[1] * F.size(ordered)).cast("int")))
    return {"min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "approx_count_distinct": F.approx_count_distinct}[name](x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
