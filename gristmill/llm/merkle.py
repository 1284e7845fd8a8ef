"""A Merkle manifest of a dataset, by message passing between the nodes of its trees.

Rows are leaves of one tree a group, runs of three at each level, and the groups'
roots are the leaves of one more tree. Supersteps on RDDs go upward: the children
of ``BLOCK`` (3^5) neighbouring nodes message the block they lie in, a block
whose children have all arrived hashes five levels and forwards what is left to
its parent block. Reverse supersteps go down: a block that knows the path above
it tells each block below its own siblings and that path, and last each row. A
superstep moves five levels, so ten thousand million rows of a group take five
of them, and a message holds at most ``BLOCK`` hashes or one path. What each
superstep has received is a table in the shared folder.

A proof is text: a level's siblings in order with ``|`` in the row's own place,
levels joined by ``/`` from the leaf to the root. So a level with the hash so
far put for its bar is just what has to be hashed, see :func:`folded`.

Null values hash as ``-``; empty texts don't. Rows that are equal in all fields
are leaves of their own, in neighbouring places; rows with null order values come
first. Null groups are a group, the first. An empty table has no manifest rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gristmill.llm.common import stored, whole_groups
from gristmill.llm.scans import partitions, running

FAN = 3
LEVELS = 5
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STATE = "tree long, block long, size long, nodes array<string>"
PATH = "tree long, block long, path string, subroot string, root string"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each told by its length in bytes."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and a proof lead to."""
    steps = F.aggregate(F.split(proof, "/"), leaf, lambda found, level: F.sha2(F.replace(level, F.lit("|"), found), 256))
    return F.when(proof == "", leaf).otherwise(steps)


def siblings(proof: Column) -> Column:
    """The hashes of a proof, one after another."""
    return F.translate(proof, "|/", "")


def _hash(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above ``size`` nodes."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def supersteps(size: int) -> int:
    return max(1, -(-height(size) // LEVELS))


def _levels(nodes: list[str], size: int) -> list[list[str]]:
    """A block's nodes and what they hash to, level by level."""
    found = [list(nodes)]
    for _ in range(min(LEVELS, height(size))):
        now = found[-1]
        found.append([_hash(now[i : i + FAN]) for i in range(0, len(now), FAN)])
    return found


def _paths(nodes: list[str], size: int, above: str) -> tuple[list[str], str]:
    """The path of each of a block's nodes to the root, and the block's own hash."""
    levels = _levels(nodes, size)
    paths = [above]
    for row in reversed(levels[:-1]):
        below = []
        for i in range(len(row)):
            a = i - i % FAN
            step = "".join(row[a:i]) + "|" + "".join(row[i + 1 : a + FAN])
            upper = paths[i // FAN]
            below.append(f"{step}/{upper}" if upper else step)
        paths = below
    return paths, levels[-1][0]


def _packed(rows: Iterable) -> Iterator[tuple]:
    """Messages of neighbouring rows to one block travel as one."""
    now, held = None, []
    for tree, at, size, node in rows:
        key = (tree, at // BLOCK)
        if key != now or len(held) >= BLOCK:
            if held:
                yield now, (held_size, held)
            now, held = key, []
        held_size = size
        held.append((at % BLOCK, node))
    if held:
        yield now, (held_size, held)


def _received(item: tuple) -> tuple:
    (tree, block), messages = item
    messages = list(messages)
    nodes = sorted(n for _, some in messages for n in some)
    return tree, block, messages[0][0], [n for _, n in nodes]


def _climbed(row) -> tuple[int, int, int, str, bool]:
    """A block's message to its parent; the last field tells that the tree is done."""
    top = _levels(row.nodes, row.size)[-1][0]
    return row.tree, row.block, -(-row.size // BLOCK), top, height(row.size) <= LEVELS


def _ascended(leaves: RDD, count: int, largest: int, most: int, spark) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each superstep, and (tree, node) of the trees' roots.

    ``leaves`` are (tree, place, size of the tree, hash); ``count`` is how many
    there are, ``largest`` the size of the largest tree.
    """
    states, done = [], None
    messages = leaves.mapPartitions(_packed)
    for step in range(supersteps(largest)):
        parts = max(1, min(most, count // BLOCK ** (step + 1) // 32))
        got = messages.groupByKey(most if not step else parts).map(_received)
        states.append(stored(spark.createDataFrame(got, STATE, verifySchema=False), "merkle-blocks"))
        sent = states[-1].rdd.map(_climbed)
        roots = sent.filter(lambda m: m[4]).map(lambda m: (m[0], m[3]))
        done = roots if done is None else done.union(roots)
        messages = sent.filter(lambda m: not m[4]).map(lambda m: m[:4]).mapPartitions(_packed)
    return states, stored(spark.createDataFrame(done, "tree long, node string", verifySchema=False), "merkle-roots")


def _descended(item: tuple) -> Iterator[tuple]:
    (tree, block), ((size, nodes), (path, subroot, root)) = item
    for i, p in enumerate(_paths(nodes, size, path)[0]):
        yield (tree, block * BLOCK + i), (p, subroot or nodes[i], root)


def _told(states: list[DataFrame], tops: list[RDD], last: int, most: int, spark) -> RDD:
    """Messages ((tree, block), (path, subroot, root)) down to superstep ``last``'s blocks; ``tops`` are those each superstep starts from."""
    now = tops[-1]
    for step in range(len(states) - 1, last - 1, -1):
        blocks = states[step].rdd.map(lambda r: ((r.tree, r.block), (r.size, r.nodes)))
        below = blocks.join(now, min(most, blocks.getNumPartitions())).flatMap(_descended)
        kept = stored(spark.createDataFrame(below.map(lambda m: (*m[0], *m[1])), PATH, verifySchema=False), "merkle-paths")
        now = kept.rdd.map(lambda r: ((r.tree, r.block), (r.path, r.subroot, r.root)))
        if step and step - 1 < len(tops):
            now = now.union(tops[step - 1])
    return now


def _rows_with_proofs(placed: DataFrame, paths: DataFrame) -> DataFrame:
    """Each row of ``placed`` with its proof: a block's path comes before its rows."""
    own = placed.select("tree", F.expr(f"(place - 1) div {BLOCK}").alias("block"), "place", F.col("rows").alias("size"), "leaf", "scan_kept", *[F.lit(None).cast("string").alias(c) for c in ("path", "subroot", "root")])
    above = paths.select("tree", "block", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("size"), *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("leaf", "scan_kept")], "path", "subroot", "root")
    dealt = own.union(above).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    schema = StructType([placed.schema["scan_kept"], *[StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof")]])

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["tree", "block"]):
            ends = np.append(starts[1:], table.num_rows)
            sizes, subroots, roots, above = (table.column(c).to_pylist() for c in ("size", "subroot", "root", "path"))
            leaves = table.column("leaf").to_pylist()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                m = b - a - 1
                part = table.slice(a + 1, m)
                found = _paths(leaves[a + 1 : b], sizes[a + 1], above[a])[0]
                rest = [leaves[a + 1 : b], [subroots[a]] * m, [roots[a]] * m, found]
                columns = [pa.concat_arrays(part.column("scan_kept").chunks), *[pa.array(x, pa.string()) for x in rest]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return dealt.mapInArrow(told, schema).select("scan_kept.*", "leaf", "subroot", "root", "proof")


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: what ``keep`` names (``order`` by default), leaf, subroot, root, proof.

    ``keep`` gives names and expressions over ``docs`` that travel along; it may
    not use the four names above.
    """
    spark = docs.sparkSession
    keep = keep or {order: F.col(order)}
    if set(keep) & {"leaf", "subroot", "root", "proof"}:
        raise ValueError("leaf, subroot, root and proof are the manifest's own")
    name = F.col(group).cast("string")
    leaves = docs.select(
        # sorts as UTF-8 bytes do, null first, and is never null itself
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("scan_group"),
        F.col(order).alias("scan_order"),
        leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        F.struct(*[c.alias(k) for k, c in keep.items()]).alias("scan_kept"),
        # tells equal rows apart, so that a hot row can be dealt to several tasks
        F.monotonically_increasing_id().alias("scan_tie"),
    )
    leaves = stored(leaves, "merkle-leaves")
    ordered = running(leaves, "scan_group", [F.col("scan_order").asc_nulls_first(), F.col("leaf"), F.col("scan_tie")], name="merkle-order")
    # groups are numbered in order the same way, all of them under one key
    groups = ordered.where("place = 1").select(F.lit(0).cast("long").alias("scan_all"), "scan_group", "rows")
    numbers = stored(running(groups.withColumnRenamed("rows", "size"), "scan_all", [F.col("scan_group")], name="merkle-groups").select("scan_group", (F.col("place") - 1).alias("tree"), "size", F.col("rows").alias("trees")), "merkle-numbers")
    most = partitions(docs)
    total = numbers.agg(F.max("size").alias("largest"), F.sum("size").alias("count"), F.max("trees").alias("trees")).first()
    placed = stored(ordered.join(numbers.select("scan_group", "tree"), "scan_group").select("tree", "place", "rows", "leaf", "scan_kept"), "merkle-placed")
    if not total["count"]:
        return placed.select("scan_kept.*", "leaf", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof")])
    rows = placed.select("tree", F.col("place") - 1, "rows", "leaf").rdd.map(tuple)
    states, subroots = _ascended(rows, total["count"], total["largest"], most, spark)
    known = numbers.join(subroots, "tree")
    upper, roots = _ascended(known.select(F.lit(0).cast("long"), "tree", "trees", "node").rdd.map(tuple), total["trees"], total["trees"], most, spark)
    root = roots.first()["node"]
    start = spark.sparkContext.parallelize([((0, 0), ("", None, root))], 1)
    down = _told(upper, [*[spark.sparkContext.parallelize([], 1)] * (len(upper) - 1), start], 0, most, spark)
    # of the upper tree's leaves each is a group's root: its path starts at the superstep where the group's tree was done
    sizes = numbers.select("tree", "size").rdd.map(lambda r: (r.tree, r.size))
    begun = down.map(lambda m: (m[0][1], m[1])).join(sizes, most).map(lambda x: (supersteps(x[1][1]) - 1, ((x[0], 0), x[1][0])))
    begun = stored(spark.createDataFrame(begun.map(lambda x: (x[0], *x[1][0], *x[1][1])), f"step int, {PATH}", verifySchema=False), "merkle-begun")
    tops = [begun.where(F.col("step") == s).rdd.map(lambda r: ((r.tree, r.block), (r.path, r.subroot, r.root))) for s in range(len(states))]
    told = _told(states, tops, 1, most, spark)
    paths = stored(spark.createDataFrame(told.map(lambda m: (*m[0], *m[1])), PATH, verifySchema=False), "merkle-paths")
    return _rows_with_proofs(placed, paths)


def verified(manifest: DataFrame, leaf: Column | str = "leaf") -> DataFrame:
    """``manifest`` with the root that ``leaf`` leads to, and whether it is the manifest's."""
    found = folded(F.col(leaf) if isinstance(leaf, str) else leaf, F.col("proof"))
    return manifest.withColumn("folded_root", found).withColumn("verified", F.col("folded_root") == F.col("root"))
