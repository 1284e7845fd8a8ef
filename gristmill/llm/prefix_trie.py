"""The trie of conversations' prefixes, built compressed.

A node is a distinct sequence of first turns. Prefixes are told apart by 128-bit
digests that grow by one turn at a time (the exclusive or of a hash of each turn
and its depth), so a conversation of any length is dealt to tasks by ranges of
its turns. As one such conversation can't be a single key, the sort that brings
equal prefixes side by side sorts their digests, not whole sequences.

As a Patricia trie it has points only where prefixes branch, where a
conversation ends, and at leaves; a run of prefixes that all go on with the same
turn makes no point. Each conversation's path holds the points on it, and the
text bytes at each, so an edge's bytes are a difference. Leaves, and the bytes
saved below a point, are sums over the paths of what each adds from there on
down (an edge counts on the path of its smallest conversation only), so no
level has to wait for the one below. Last the unary nodes of an edge take the
values of the point below it and the rest of the edge's bytes.

Equal conversations are one path with a weight. Rows with a null conv_id belong
to no conversation and are left out; null roles and texts are empty; rows of
equal turn are ordered by the md5 of role and text, and repeated rows are turns
of their own. A table without conversations has no nodes, not even a root. The
one thing that is sequential by definition is the hash of a node's own list of
ends: it is streamed from strings of ``ENDS`` numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored
from gristmill.llm.scans import running

ENDS = 1_000
HEADS = 9
SHARE = 5
NODE = ["p1", "p2", "depth"]
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, content (a digest of role and text), bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("content"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def rebuilt_conversations(conversations: DataFrame, share: int = SHARE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations, and (conv, depth, content, bytes) of their turns, rebuilt.

    A conversation c starts with the first h turns of c - c % ``share``, h being
    crc32(c) % ``heads``, and goes on with its own turns after its first h.
    """
    turns = stored(_turns(conversations), "trie-turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv") - F.col("conv") % share).alias("source"))
    source = convs.select(F.col("conv").alias("source"), F.col("n").alias("there"))
    info = stored(convs.join(source, "source", "left").select("conv", "source", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "trie-convs")
    placed = stored(running(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("content")], per_key=info.select("conv", "h", "taken"), name="trie-order"), "trie-placed")
    own = placed.where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "content", "bytes")
    # fewer than ``heads`` turns of a source, so a hot one sends no more than others
    first = placed.where(F.col("place") < heads).select(F.col("conv").alias("source"), F.col("place").alias("depth"), "content", "bytes")
    taken = first.join(info.where("taken > 0").select("conv", "source", "taken"), "source").where("depth <= taken").select("conv", "depth", "content", "bytes")
    return info.select("conv"), own.union(taken)


def _classes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal conversations (p1, p2, depth, conv, copies), and members (conv, rep) of those with several."""
    totals = turns.groupBy("conv").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"), F.count("*").alias("depth"))
    totals = stored(convs.join(totals, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NODE]), "trie-digests")
    classes = stored(totals.groupBy(*NODE).agg(F.min("conv").alias("rep"), F.count("*").alias("copies")), "trie-classes")
    members = totals.join(classes.where("copies > 1").drop("copies"), NODE).select("conv", "rep")
    return classes, stored(members, "trie-members")


def _ends(classes: DataFrame, members: DataFrame) -> DataFrame:
    """rep, and the SHA-256 of its class's conv_ids in order, comma-joined."""
    placed = running(members, "rep", [F.col("conv")], name="trie-ends")
    parts = placed.groupBy("rep", F.expr(f"(place - 1) div {ENDS}").alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    dealt = stored(parts, "trie-end-lists").repartition("rep").sortWithinPartitions("rep", "part")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            done = []
            for r, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r == rep:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    single = classes.where("copies = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    return single.union(dealt.mapInArrow(hashed, "rep long, ends_sha256 string"))


def _prefixes(turns: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each prefix of each distinct conversation, with its digest, the text bytes up to it and what comes next."""
    paths = classes.select(F.col("rep").alias("conv"), "copies", F.col("depth").alias("length"))
    # from the end to the start, so that the row before is the turn that comes next
    found = running(turns, "conv", [F.col("depth").desc()], xors=["x1", "x2"], sums=["bytes"], previous=["x1", "x2"], per_key=paths, name="trie-prefixes")

    def digest(x: str) -> Column:
        return F.col(f"total_{x}").bitwiseXOR(F.col(f"running_{x}")).bitwiseXOR(F.col(x))

    return found.where("copies is not null").select(
        "conv", "copies", "length", digest("x1").alias("p1"), digest("x2").alias("p2"), "depth", "bytes",
        (F.col("total_bytes") - F.col("running_bytes") + F.col("bytes")).alias("upto"),
        F.when(F.col("previous_x1").isNotNull(), F.struct("previous_x1", "previous_x2")).alias("next"),
    )


def _points(prefixes: DataFrame) -> DataFrame:
    """Branches, ends and leaves; their smallest conversation and how many they hold."""
    runs = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.sum("copies").alias("n_convs"), F.first("bytes").alias("own_bytes"),
        F.max(F.col("depth") == F.col("length")).alias("ends"), F.min("next").alias("low"), F.max("next").alias("high"),
    )
    return runs.where("ends or low <> high").select(*NODE, "owner", "n_convs", "own_bytes", "ends", F.isnull("low").alias("leaf"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv) with ``turns`` (conv, depth from 1, content, bytes).

    Gives conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes that members share, over the subtree)
    and ends_sha256, the root included.
    """
    keyed = turns.select("conv", "depth", "bytes", F.xxhash64("content", "depth").alias("x1"), F.xxhash64(F.lit("again"), "depth", "content").alias("x2"))
    keyed = stored(keyed, "trie-rebuilt")
    classes, members = _classes(convs, keyed)
    ends = stored(classes.join(_ends(classes, members), "rep").select(*NODE, "ends_sha256"), "trie-ends")
    prefixes = stored(_prefixes(keyed, classes), "trie-prefixes")
    points = stored(_points(prefixes), "trie-points")

    # the compressed tree: paths that hold points only
    paths = stored(prefixes.join(points, NODE), "trie-paths")
    children = paths.where("next is not null").groupBy(*NODE, "next").agg(F.lit(1).alias("one")).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    edges = running(paths.select(*NODE, "conv", "upto", "owner", "n_convs", F.col("leaf").cast("long").alias("leaf")), "conv", [F.col("depth")], previous=["upto", "owner", "depth"], name="trie-edges")
    edges = edges.withColumn("edge", F.when(F.col("owner") == F.col("conv"), (F.col("n_convs") - 1) * (F.col("upto") - F.coalesce("previous_upto", F.lit(0)))).otherwise(F.lit(0)))
    below = running(stored(edges.drop("place", "rows"), "trie-edges"), "conv", [F.col("depth").desc()], sums=["edge", "leaf"], name="trie-below")
    below = stored(below, "trie-sums")
    here = F.col("owner") == F.col("conv")
    sums = below.groupBy(*NODE).agg(
        F.sum(F.col("running_edge") - F.col("edge")).alias("below"), F.sum("total_leaf").alias("n_leaves"),
        F.max(F.when(here, F.col("upto"))).alias("upto_point"), F.max(F.when(here, F.col("previous_owner"))).alias("up_owner"), F.max(F.when(here, F.coalesce("previous_depth", F.lit(0)))).alias("up_depth"),
    )
    stats = points.join(sums, NODE).join(children, NODE, "left").join(ends, NODE, "left")
    point = F.struct(F.col("depth").alias("at"), "owner", "n_convs", "n_leaves", "below", "upto_point", "up_owner", "up_depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends_sha256")
    stats = stored(stats.select(*NODE, point.alias("point")), "trie-stats")

    none = F.sha2(F.lit("").cast("binary"), 256)
    # the root is one row, its values are one row each
    root = classes.agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs")).first()
    tops = prefixes.where("depth = 1").select("p1", "p2").distinct().count()
    total = below.agg(F.sum("edge").alias("saved"), F.sum("leaf").alias("leaves")).first()
    own = ends.where("depth = 0").first()
    values = [] if root["conv_id"] is None else [(root["conv_id"], 0, None, root["n_convs"], tops, total["leaves"] or 1, total["saved"] or 0, own["ends_sha256"] if own else hashlib.sha256().hexdigest())]
    top = convs.sparkSession.createDataFrame(values, SCHEMA)

    # unary nodes take what the point below them has
    spread = prefixes.select("conv", *NODE, "bytes", "upto").join(stats, NODE, "left")
    spread = running(stored(spread.select("conv", "depth", "bytes", "upto", "point"), "trie-spread"), "conv", [F.col("depth").desc()], fills=["point"], name="trie-nodes")
    p = F.col("filled_point")
    unary = F.col("depth") < p["at"]
    rest = spread.where(p["owner"] == F.col("conv")).select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > p["up_depth"] + 1, F.col("conv")).otherwise(F.coalesce(p["up_owner"], F.lit(root["conv_id"]))).alias("parent_conv_id"),
        p["n_convs"].alias("n_convs"), F.when(unary, F.lit(1)).otherwise(p["n_children"]).cast("long").alias("n_children"), p["n_leaves"].alias("n_leaves"),
        (p["below"] + (p["n_convs"] - 1) * (p["upto_point"] - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
        F.when(unary | p["ends_sha256"].isNull(), none).otherwise(p["ends_sha256"]).alias("ends_sha256"),
    )
    return rest.union(top)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, see :func:`rebuilt_conversations`."""
    return prefix_trie(*rebuilt_conversations(conversations))
