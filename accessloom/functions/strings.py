"""Strings (R-156)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that wrap a string.
WRAPPERS = {"single": "''", "double": '""', "tack": "``", "parentheses": "()", "square": "[]", "angle": "<>"}


def wrap(c: Column, wrapper: str | None = None) -> Column:
    return F.concat(F.lit(WRAPPERS[wrapper][0]), c, F.lit(WRAPPERS[wrapper][1])) if wrapper else c


def oxford(items: Column, conjunction: str = "and", separator: str = ",", inner: str | None = None, outer: str | None = None, empty: str = "") -> Column:
    """`a`, `a and b`, `a, b, and c`."""
    items = F.transform(items, lambda x: wrap(x, inner))
    n = F.size(items)
    last = F.element_at(items, -1)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), f"{separator} "), F.lit(f"{separator} {conjunction} "), last)
    two = F.concat(F.element_at(items, 1), F.lit(f" {conjunction} "), last)
    return wrap(F.when(n == 0, F.lit(empty)).when(n == 1, last).when(n == 2, two).otherwise(many), outer)


def trim_quotes(c: Column) -> Column:
    """Without one layer of equal quotes around it."""
    first, inner = F.left(c, F.lit(1)), F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when((F.length(c) > 1) & first.isin("'", '"', "`") & (first == F.right(c, F.lit(1))), inner).otherwise(c)


def split_full_name(c: Column) -> Column:
    """first (the first word) and last (the rest)."""
    parts = F.split(c, " ", 2)
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last"))


def parse_flags(c: Column) -> Column:
    """A map of `--name value` pairs; a flag without a value is "true", and a repeated one gathers its values with commas."""
    body = F.trim(c)
    pieces = F.filter(F.split(F.concat(F.lit(" "), body), " --"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(F.substring_index(p, " ", 1).alias("k"), F.when(F.contains(p, F.lit(" ")), trim_quotes(F.substring(p, F.length(F.substring_index(p, " ", 1)) + 2, F.length(p)))).otherwise(F.lit("true")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.array_join(F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"]), ",")))
