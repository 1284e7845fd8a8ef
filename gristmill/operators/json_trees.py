"""JSON texts of any depth as rows.

Trees of lists (``tree_rows``, ``tree_places``) are walked where their texts lie, each
text once and in the pre-order, so there is neither a pass a level nor a sort. Named
values are exploded level by level inside the JVM from a text parsed to a variant,
until a level has no rows; each level is a checkpoint in the shared folder. A node's
``path`` lists its places from the root down; lists compare element by element, so
sorting by path is the pre-order. The members of an object stand in the order of their
names; the walk takes the first of two with one name. Null, empty and broken texts
have no rows, nor has what is nested deeper than the parser allows (variants: 1,000
levels, the walk: some thousands, by Python's version).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gristmill.operators.graphs import kept

_PLACES = "array<int>"
#: Nodes (with the places in their paths), and characters of their texts, after which a batch leaves.
TOGETHER, CHARACTERS = 20_000, 4_000_000
_STEP = r"""\.([^.\[]+)|\['([^']*)'\]|\["([^"]*)"\]|\[([0-9]+)\]"""
#: Digits that fit a type of integers whatever they are.
_DIGITS = {"int": 9, "integer": 9, "bigint": 18, "long": 18}
#: What a missing member is read as; no JSON value, and itself in every process.
_MISSING = ...


def _levels(nodes: DataFrame, below: Column) -> Iterator[DataFrame]:
    """``nodes`` (owner, path, node) and all that lies below them, a frame a level."""
    level = kept(nodes)
    while not level.isEmpty():
        yield level
        down = level.select("owner", "path", F.posexplode(below).alias("place", "node"))
        level = kept(down.select("owner", F.concat("path", F.array("place")).alias("path"), "node"))


def _roots(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return rows.select(F.struct(*keys).alias("owner"), F.try_parse_json(F.col(text)).alias("node")).where("node is not null")


def _together(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.union(p)
    return out


def _steps(path: str) -> list[str | int]:
    """The names and places that ``path`` (``$.a.b[0]['c']``) leads by."""
    if not re.fullmatch(rf"\$(?:{_STEP})*", path):
        raise ValueError(f"not a path: {path}")
    return [int(m[4]) if m[4] else m[1] or m[2] or m[3] or "" for m in re.finditer(_STEP, path)]


def _read(nodes: list[Any], steps: Sequence[str | int]) -> list[Any]:
    """What stands behind ``steps`` in each parsed value, or ``_MISSING``."""
    for s in steps:
        if type(s) is str:
            nodes = [n.get(s, _MISSING) if type(n) is dict else _MISSING for n in nodes]
        else:
            nodes = [n[s] if type(n) is list and s < len(n) else _MISSING for n in nodes]
    return nodes


def _first(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    return dict(reversed(pairs))


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _parser() -> Callable[[str], Any]:
    return json.JSONDecoder(object_pairs_hook=_first, parse_constant=_no_number).decode


def _as_json(value: Any) -> str | None:
    return None if value is _MISSING else json.dumps(value, sort_keys=True, separators=(",", ":"))


def _as_text(value: Any) -> str | None:
    return None if value is None or value is _MISSING else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair, which the JVM reads as a question mark, too
        return pa.array([v and v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _walked(roots: Any, children: Sequence[str | int], paths: bool) -> Iterator[tuple[Any, Any]]:
    """(path or depth, node) of the nodes under a list of roots, in the pre-order."""

    def under(at: Any, nodes: Any) -> Iterable[tuple[Any, Any]]:
        if type(nodes) is not list:
            return ()
        return [((*at, i), nodes[i]) for i in range(len(nodes) - 1, -1, -1)] if paths else zip(repeat(at + 1), reversed(nodes))

    name = children[0] if len(children) == 1 else None
    stack = list(under(() if paths else -1, roots))
    while stack:
        at, node = found = stack.pop()
        yield found
        inner = node.get(name) if type(node) is dict and type(name) is str else _read([node], children)[0]
        if inner:
            stack += under(at, inner)


def _typed(column: str, kind: str) -> Column:
    """A member that left the walk, a text for texts and else JSON, as its type; a short whole number needs no variant."""
    value = F.col(column)
    if kind == "string":
        return value
    read = F.try_variant_get(F.try_parse_json(value), "$", kind)
    if kind not in _DIGITS:
        return read
    return F.when(value.rlike(f"^-?[0-9]{{1,{_DIGITS[kind]}}}$"), value.cast(kind)).otherwise(read)


def _nodes(rows: DataFrame, keys: Sequence[str], text: str, roots: str, children: str, fields: Mapping[str, tuple[str, str]], paths: bool) -> DataFrame:
    """keys, path or else place and depth, and ``fields`` of each node."""
    told = rows.select(*[F.col(k).alias(f"key{n}") for n, k in enumerate(keys)], F.col(text).alias("text"))
    kinds = [kind for _, kind in fields.values()]
    where = [("path", ArrayType(IntegerType()))] if paths else [("place", IntegerType()), ("depth", IntegerType())]
    members = [f"member{n}" for n in range(len(kinds))]
    columns = [*told.schema.fields[:-1], *[StructField(n, t) for n, t in where], *[StructField(n, StringType()) for n in members]]
    top, below = _steps(roots), _steps(children)
    readers = [(_steps(p), *((str, _as_text) if kind == "string" else (int, _as_json))) for p, kind in fields.values()]

    def made(batch: pa.RecordBatch, found: list[tuple[int, int, Any, Any]]) -> pa.RecordBatch:
        lines, places, ats, nodes = map(list, zip(*found, strict=True))
        own = [c.take(pa.array(lines, pa.int32())) for c in batch.columns[: len(keys)]]
        at = [pa.array(ats, pa.list_(pa.int32()))] if paths else [pa.array(places, pa.int32()), pa.array(ats, pa.int32())]
        values = [_strings([str(v) if type(v) is plain else told_as(v) for v in _read(nodes, steps)]) for steps, plain, told_as in readers]
        return pa.RecordBatch.from_arrays([*own, *at, *values], names=[f.name for f in columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _parser()
        for batch in batches:
            found, size, characters = [], 0, 0
            for line, body in enumerate(batch.column(len(keys))):
                body = body.as_py() or ""
                try:
                    tree = parsed(body)
                except (ValueError, RecursionError):
                    continue
                characters += len(body)
                for place, (at, node) in enumerate(_walked(_read([tree], top)[0], below, paths)):
                    found.append((line, place, at, node))
                    size += 1 + len(at) if paths else 1
                    if size >= TOGETHER:
                        yield made(batch, found)
                        found, size, characters = [], 0, 0
                if characters >= CHARACTERS and found:
                    yield made(batch, found)
                    found, size, characters = [], 0, 0
            if found:
                yield made(batch, found)

    found = told.mapInArrow(run, StructType(columns))
    return found.select(*[F.col(f"key{n}").alias(k) for n, k in enumerate(keys)], *[n for n, _ in where], *[_typed(m, kind).alias(n) for m, n, kind in zip(members, fields, kinds, strict=True)])


def tree_rows(rows: DataFrame, keys: Sequence[str], text: str, roots: str, children: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """keys, path and ``fields`` of each node of the trees in ``text``.

    ``roots`` is where a text holds its list of roots and ``children`` where a node
    holds its own list; ``fields`` gives name -> (path in a node, type). A value of
    another type is null, and so is a list that isn't one.
    """
    return _nodes(rows, keys, text, roots, children, fields, True)


def tree_places(rows: DataFrame, keys: Sequence[str], text: str, roots: str, children: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """As ``tree_rows``, with ``place`` in the pre-order of the text, from 0, and ``depth`` instead of the path."""
    return _nodes(rows, keys, text, roots, children, fields, False)


def named_values(rows: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    """keys, path, value: what ``name`` holds in any object at any depth; other values than texts as JSON, nulls left out.

    ``path`` leads to the object, so an object comes before what it holds.
    """
    below = F.coalesce(F.try_variant_get("node", "$", "array<variant>"), F.map_values(F.try_variant_get("node", "$", "map<string,variant>")))
    first = _roots(rows, keys, text).select("owner", F.array().cast(_PLACES).alias("path"), "node")
    members = F.try_variant_get("node", "$", "map<string,variant>")

    def found(level: DataFrame) -> DataFrame:
        own = level.select("owner", "path", F.try_element_at(members, F.lit(name)).alias("own"))
        return own.select("owner.*", "path", F.try_variant_get("own", "$", "string").alias("value")).where("value is not null")

    return _together([found(x) for x in _levels(first, below)], found(first.limit(0)))


def tree_prints(stages: DataFrame, process: Sequence[str], fields: Sequence[Column], path: str = "path") -> DataFrame:
    """process, fingerprint: equal for processes whose trees agree in shape and fields.

    From the deepest level up, a stage is digested with the digests of its children
    in their order, and its process with those of its roots; so what meets in a
    row is one stage's children, never a process. A stage whose parent isn't there
    counts for nothing.
    """
    own = F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields])
    nodes = kept(stages.select(F.struct(*process).alias("owner"), F.col(path).alias("path"), own.alias("own")))
    deepest = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.size("path") == depth)
        if below is not None:
            level = level.join(below, ["owner", "path"], "left")
            digest = F.sha2(F.concat_ws("\u001e", "own", F.coalesce("digest", F.lit(""))), 256)
        else:
            digest = F.sha2(F.concat("own", F.lit("\u001e")), 256)
        listed = F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("place"), digest.alias("digest"))))
        whole = F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256).alias("digest")
        below = kept(level.groupBy("owner", F.slice("path", 1, depth - 1).alias("path")).agg(whole))
    if below is None:
        return nodes.select("owner.*", F.lit("").alias("fingerprint")).limit(0)
    return below.select("owner.*", F.col("digest").alias("fingerprint"))
