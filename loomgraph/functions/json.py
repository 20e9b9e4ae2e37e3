"""JSON text as Column expressions; a field whose value is null is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js(c: Column) -> Column:
    """A scalar as JSON text; null stays null."""
    return let(F.to_json(F.array(c)), lambda t: F.when(t != "[null]", F.substring(t, F.lit(2), F.length(t) - 2)))


def obj(**fields: Column) -> Column:
    """An object of JSON texts; names are given with __ for what no identifier may hold (kg__x is kg:x, at__id is @id)."""
    name = lambda k: k.replace("at__", "@").replace("__", ":")
    parts = [F.concat(F.lit(f'"{name(k)}":'), v) for k, v in fields.items()]  # null where the value is
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def fields(*objects: Column) -> Column:
    """The objects' fields as one object; null and empty ones add nothing, repeated names stay."""
    inner = [F.when(F.length(F.trim(o)) > 2, F.regexp_replace(F.trim(o), r"^\{|\}$", "")) for o in objects]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*inner)), ","), F.lit("}"))


def prefixed(o: Column, prefix: str) -> Column:
    """An object with a prefix before the names of its fields; their values stay as they are."""
    m = F.from_json(o, "map<string, variant>")
    return F.to_json(F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k)))


def union(old: Column, new: Column, new_wins: bool = True) -> Column:
    """Fields of both objects; of one name the new value counts, or the old one."""
    first, then = (F.coalesce(F.from_json(x, "map<string, variant>"), F.from_json(F.lit("{}"), "map<string, variant>")) for x in ((new, old) if new_wins else (old, new)))
    keep = let(first, lambda m: F.map_concat(m, let(F.map_keys(m), lambda known: F.map_filter(then, lambda k, _: ~F.array_contains(known, k)))))
    return let(keep, lambda m: F.when(F.size(m) > 0, F.to_json(m)))


def canonical(o: Column) -> Column:
    """JSON text as `union` writes it, with the names of an object in order."""
    return F.to_json(F.parse_json(o))


def items(o: Column, path: str) -> Column:
    """The elements of the array at a path, each as canonical text; none where there is no array."""
    found = F.from_json(F.get_json_object(o, path), "array<variant>")
    return F.coalesce(F.transform(found, lambda v: F.to_json(v)), F.array().cast("array<string>"))


def array(texts: Column) -> Column:
    """An array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
