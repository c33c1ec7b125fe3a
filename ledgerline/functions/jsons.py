"""JSON held in strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    """Sorted keys, no blanks, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def valid(c: Column) -> Column:
    """The JSON written anew, null if it is none."""
    return F.to_json(F.try_parse_json(c))


def compact_fields(c: Column) -> Column:
    """Last path segment without its number -> value, of an array of (path, value); blanks and dashes dropped, the first of equal keys wins."""
    pairs = F.from_json(c, "array<array<string>>")
    named = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.trim(F.element_at(F.split(F.get(p, 0), ">"), -1)), r"^[0-9]+\.\s*", "").alias("k"), F.trim(F.get(p, 1)).alias("v")))
    full = F.filter(named, lambda x: (x["k"] != "") & x["v"].isNotNull() & ~x["v"].isin("", "-"))
    keys = F.transform(full, lambda x: x["k"])
    first = F.filter(full, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_entries(first)


def changed(c: Column) -> Column:
    """The entries of a list of differences whose value before and after differ."""
    return F.filter(F.from_json(c, "array<struct<item:string,before:string,after:string,reason:string>>"), lambda x: ~x["before"].eqNullSafe(x["after"]))


def present(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


#: Levels that a nested value may have.
DEPTH = 32


def frozen(value: object, depth: int = DEPTH) -> object:
    """A JSON value that nobody can change: objects as sorted pairs, arrays as tuples. Too deep values, cycles among them, and numbers that JSON can't hold are refused."""
    if depth < 0:
        raise ValueError(f"a value may have {DEPTH} levels at most")
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("an object's keys are strings")
        return ("object", tuple((k, frozen(value[k], depth - 1)) for k in sorted(value)))
    if isinstance(value, (list, tuple)):
        return ("array", tuple(frozen(v, depth - 1) for v in value))
    if value is not None and not isinstance(value, (str, int, float, bool)) or isinstance(value, float) and not math.isfinite(value):
        raise TypeError(f"no JSON value: {value!r}")
    return value


def thawed(value: object) -> object:
    """The value that was frozen, new throughout."""
    if not isinstance(value, tuple):
        return value
    kind, parts = value
    return {k: thawed(v) for k, v in parts} if kind == "object" else [thawed(v) for v in parts]
