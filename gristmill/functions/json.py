"""Reading and changing JSON texts, inside the JVM. A null or broken text gives nulls, false or no rows; see ``operators/json_trees`` for any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_items(json: Column, path: str) -> Column:
    """Whether the list at ``path`` holds anything; a missing path or another kind of value doesn't."""
    return F.coalesce(F.json_array_length(F.get_json_object(json, path)) > 0, F.lit(False))


def is_true(json: Column, path: str) -> Column:
    """Whether the value at ``path`` is the boolean true; null, missing and the text "true" of another type read alike."""
    return F.coalesce(F.get_json_object(json, path) == "true", F.lit(False))


def value_at(json: Column, name: Column) -> Column:
    """The top-level value of a name that differs by row."""
    return F.get(F.map_values(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k == name)), F.lit(0))


def without_keys(json: Column, *names: str) -> Column:
    """The names and texts of a JSON object's values as a map, without some names."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*names))


def listed(rows: DataFrame, json: str, path: str, kind: str, name: str = "item") -> DataFrame:
    """A row for each value of the list at ``path``, with its place ``pos``."""
    return rows.select("*", F.posexplode(F.from_json(F.get_json_object(json, path), f"array<{kind}>")).alias("pos", name))


def without_paths(json: Column, *paths: str) -> Column:
    """A JSON object's text without some members; a path names a member of a member with a dot ("a.b").

    Types stay, names come in order. A path that leads nowhere removes nothing; a text that
    is no object stays as it is, a broken one is null.
    """

    def rest(value: Column, some: list[list[str]]) -> Column:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        here = [p[0] for p in some if len(p) == 1]
        left = F.map_filter(members, lambda k, _: ~k.isin(*here)) if here else members
        below: dict[str, list[list[str]]] = {}
        for p in some:
            if len(p) > 1:
                below.setdefault(p[0], []).append(p[1:])
        for name, inner in below.items():
            left = F.transform_values(left, within(name, inner))
        return F.coalesce(F.to_json(left), F.to_json(value))

    def within(name: str, inner: list[list[str]]):
        return lambda k, v: F.when((k == name) & F.schema_of_variant(v).startswith("OBJECT"), F.try_parse_json(rest(v, inner))).otherwise(v)

    return rest(F.try_parse_json(json), [p.split(".") for p in paths])
