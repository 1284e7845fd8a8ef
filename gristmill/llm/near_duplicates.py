"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles. Documents with equal sets form one
class, and the work goes on with one set a class:

1. The ``SKETCH`` smallest hashes of a set are its sketch. Inverted lists hold
   the sets that retain a value and, next to it, the same following value: by
   chance two sets share common words, but hardly two neighbours of a sketch, so
   lists grow with real copies. Sets of similarity 0.8 share at least ``SHARED``
   values (all but 2 in 10 million pairs at the very threshold do, and more above
   it). Where sketches hold whole sets, at most a fifth of the union parts the
   shared values into fewer runs than there are values, so two of them are
   neighbours. Longer sets share 22 neighbours on average at the threshold, so of
   those only ``LISTED`` eighths by hash make lists: all but 3 in 10 million pairs
   at the very threshold still share one.
2. A list of two sets is a pair. In longer ones the two sets with the most widely
   shared values are compared with the others. The bottom-k of the union estimates
   the similarity, and pairs that may reach the threshold are confirmed on their
   full sets. A large group of copies falls together here by a number of pairs in
   proportion to its size.
3. Lists that then still hold several components are searched in blocks of
   ``BLOCK`` sets; every pair of a list meets in one. The pairs that pass the
   estimate only serve to form groups of candidates, each set being told by one
   other. Groups are compared in tiles of texts, where shared shingles are
   counted exactly. Sets that nearly reach the threshold with thousands of
   others thus cost work in a task, but no rows.

So no list is dropped or capped, and none is gathered in one task.

Null, empty and blank texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle. Rows of the same text are one
class, ties go to the smallest id. Rows with null ids are compared too; a
component's id is the smallest that is not null, or null if there is none, and a
row with a null id is kept only where its component's id is null. Rows that
share an id but not the text are documents of their own. Other columns are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import WordHashes, components, mixed, per_text, stored, text_key, whole_groups

SKETCH, SHARED = 32, 13
#: Eighths of the neighbours in a full sketch that make lists.
LISTED = 5
#: Sets of a list that are compared at a time, and texts of half a tile.
BLOCK, TILE = 1024, 256
#: Lists of at most so many sets are compared pair by pair, longer ones by counting shared values.
FEW = 32
#: Whether long lists are compared with their centres first (1); without (0), blocks do all of it.
STAR_ROUNDS = 1
PAIRS_AT_ONCE = 100_000
LAST = np.iinfo(np.int64).max


def shingle_sets(texts: list[str], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    h = hashes.of([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        x = h[at : at + len(ws)]
        at += len(ws)
        n = min(width, len(x))
        if n:
            s = x[: len(x) - n + 1] + np.uint64(n)
            for k in range(1, n):
                s = mixed(s) * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
            x = np.unique(mixed(s).view(np.int64))
        else:
            x = x.view(np.int64)
        out.append(x)
    return out


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, size) of the bottom-k of the union, for rows of two arrays of sketches, filled up with LAST."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != LAST)
    rank = np.cumsum(~again & (both != LAST), 1)
    return (again & (rank <= SKETCH)).sum(1), np.minimum(rank[:, -1], SKETCH)


def maybe_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shared, size = union_estimate(a, b)
    return shared * SKETCH >= SHARED * size


def _rows(sketches: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.int64).reshape(-1, SKETCH)


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, text key, set size, set digest and sketch of each row."""

    def make():
        hashes = WordHashes()

        def work(ids, texts):
            out = []
            for (d, t), x in zip(ids, shingle_sets(texts, hashes, width), strict=True):
                low = np.full(SKETCH, LAST)
                low[: len(x[:SKETCH])] = x[:SKETCH]
                out.append((d, t, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None, low.tobytes()))
            return out

        return work

    ids = [F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key")]
    return per_text(docs, ids, text_col, "id long, text_key long, size long, digest binary, sketch binary", make)


def neighbours(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): a hash of each two neighbours of a sketch; of a full sketch, of those that are listed."""
    v = sketches.view(np.uint64)
    row, at = np.nonzero(sketches[:, 1:] != LAST)
    value = mixed(v[row, at] * np.uint64(0x9E3779B97F4A7C15) + v[row, at + 1])
    keep = (sketches[row, -1] == LAST) | ((value & np.uint64(7)) < LISTED)
    return row[keep], value[keep].view(np.int64)


def _lists(classes: DataFrame) -> DataFrame:
    """(value, node, sets): the inverted lists of at least two sets, and how many each has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, value = neighbours(_rows(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(0).take(pa.array(row))], ["value", "node"])

    entries = classes.select("node", "sketch").mapInArrow(run, "value long, node long")
    return entries.join(entries.groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1"), "value")


def _passed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch allows the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = (np.minimum(n, m) * 5 >= np.maximum(n, m) * 4) & maybe_similar(_rows(batch.column(3)), _rows(batch.column(5)))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    a = classes.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("s"))
    b = classes.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("t"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "s", "m", "t").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, id_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A pair takes the text of a, then meets the text of b, so no text is sent
    more often than it has pairs.
    """
    where = classes.select("node", "at_id", "at_text")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("at_id"), text_key(text_col).alias("at_text"), F.col(text_col).cast("string").alias("text"))
    b_at = where.select(F.col("node").alias("b"), F.col("at_id").alias("b_id"), F.col("at_text").alias("b_text"))
    a_at = where.withColumnRenamed("node", "a")
    first = pairs.join(b_at, "b").join(a_at, "a").join(texts, ["at_id", "at_text"]).select("a", "b", F.col("b_id").alias("at_id"), F.col("b_text").alias("at_text"), F.col("text").alias("text_a"))
    both = first.join(texts, ["at_id", "at_text"]).select("a", "b", "text_a", F.col("text").alias("text_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y != last:
                    last, held = y, shingle_sets([y], hashes, width)[0]
                mine = shingle_sets([x], hashes, width)[0]
                common = len(np.intersect1d(mine, held, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(held) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _mixed_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one component of ``links``, with ``component`` and ``members``."""
    known = stored(components(links, "near-components"), "near-components")
    lists = stored(lists.select("value", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-lists")
    kinds = lists.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    return lists.join(kinds.select("value", "members"), "value")


def _first_pairs(held: DataFrame) -> DataFrame:
    """The pairs of lists of two; in longer ones, the two sets that share most widely with all others."""
    two = held.where("sets = 2").groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    if not STAR_ROUNDS:
        return two.distinct()
    shares = held.groupBy("node").agg(F.sum(F.round(F.log2("sets") * 1000).cast("long")).alias("shares"))
    lists = stored(held.where("sets > 2").join(shares, "node").select("value", F.struct("shares", "node").alias("set")), "near-lists")
    first = lists.groupBy("value").agg(F.max("set").alias("centre"))
    second = lists.join(first, "value").where("set <> centre").groupBy("value").agg(F.max("set").alias("centre"))
    stars = lists.join(first.union(second), "value").where("set <> centre").select(F.least("set.node", "centre.node").alias("a"), F.greatest("set.node", "centre.node").alias("b"))
    return two.union(stars).distinct()


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over pairs of rows."""
    out = np.arange(n)
    while True:
        before = out.copy()
        np.minimum.at(out, left, out[right])
        np.minimum.at(out, right, out[left])
        if (out == before).all():
            return out


def shared_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, how many values each row shares with it), by lists of the rows that hold a value."""
    sizes = np.array([len(x) for x in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(value, kind="stable")
    holders, begins = owner[order], np.concatenate([[0], np.cumsum(np.bincount(value))])
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        v = value[a:b]
        n = begins[v + 1] - begins[v]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[v], n)
        yield i, np.bincount(holders[at], minlength=len(sets))


def _candidates(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): sets that may be linked, each told by the smallest row it reaches in a block of a list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["value", "lo", "hi"]):
            sizes, sketches = table.column("size").to_numpy(), _rows(table.column("sketch"))
            nodes = table.column("node").combine_chunks()
            component = table.column("component").to_numpy()
            block, across = table.column("block").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()
            ends = np.append(starts[1:], table.num_rows)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            few = ends - starts <= FEW
            for left, right in _pairs_in_groups(starts[few], ends[few]):
                ok = (component[left] != component[right]) & (~across[left] | (block[left] != block[right])) & _sizes_fit(sizes[left], sizes[right])
                left, right = left[ok], right[ok]
                ok = maybe_similar(sketches[left], sketches[right])
                found.append((left[ok], right[ok]))
            for first, last in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
                held = [x[x != LAST] for x in sketches[first:last]]
                kept = np.array([len(x) for x in held])
                for i, n in shared_counts(held):
                    row = first + i
                    least = np.minimum(SHARED, np.ceil(0.8 * np.maximum(kept, kept[i])))
                    ok = (n >= least) & (component[first:last] != component[row]) & (~across[row] | (block[first:last] != block[row])) & _sizes_fit(sizes[first:last], sizes[row])
                    near = first + np.flatnonzero(ok)
                    found.append((np.full(len(near), row), near))
            left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            label = _labels(table.num_rows, left, right)
            told = np.flatnonzero(label != np.arange(table.num_rows))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(told)), nodes.take(pa.array(label[told]))], ["a", "b"])

    n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = (
        lists.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
        .join(classes.select("node", "size", "sketch"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select("value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "size", "sketch")
    )
    return rows.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi").mapInArrow(run, "a long, b long")


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * 5 >= np.maximum(n, m) * 4


def _pairs_in_groups(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows left < right of each group [start, end), about PAIRS_AT_ONCE at a time."""
    if not len(starts):
        return
    n = ends - starts
    cut = np.searchsorted(np.cumsum(n * n), np.arange(PAIRS_AT_ONCE, int((n * n).sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE)) + 1
    for a, b in zip(np.concatenate([[0], cut[:-1]]), cut, strict=True):
        first, m = starts[a:b], n[a:b]
        at = np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        count = np.repeat(m, m)
        left = np.repeat(at, count)
        right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.repeat(first, m), count)
        ok = left < right
        yield left[ok], right[ok]


def _tile_links(candidates: DataFrame, lists: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Links within groups of candidates, confirmed on full sets.

    A group is cut into tiles of two of its blocks. The texts of a tile travel
    to it once, its pairs never leave it, and each set is told by the smallest
    one that it reaches over links within the tile.
    """
    groups = stored(components(candidates, "near-candidates"), "near-groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_blocks"))
    own = lists.groupBy("node").agg(F.first("component").alias("linked"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("at_id"), text_key(text_col).alias("at_text"), F.col(text_col).cast("string").alias("text"))
    rows = (
        groups.join(sizes, "component").join(own, "node").join(classes.select("node", "at_id", "at_text"), "node")
        .join(texts, ["at_id", "at_text"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(F.xxhash64("component").alias("tile"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "linked", "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table, starts in whole_groups(batches, ["tile", "lo", "hi"]):
            for first, last in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(first, last - first)
                nodes, linked = part.column("node").combine_chunks(), part.column("linked").to_numpy()
                sets = shingle_sets(part.column("text").to_pylist(), hashes, width)
                n = np.array([len(x) for x in sets])
                found = []
                for i, common in shared_counts(sets):
                    near = np.flatnonzero((100 * common >= percent * (n + n[i] - common)) & (linked != linked[i]))
                    found.append((np.full(len(near), i), near))
                label = _labels(len(sets), *(np.concatenate([f[k] for f in found]) for k in (0, 1)))
                told = np.flatnonzero(label != np.arange(len(sets)))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(told)), nodes.take(pa.array(label[told]))], ["a", "b"])

    return rows.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, their classes (with the ``least`` row of each), and (node, component) of the classes that are linked."""
    if percent < 80:
        raise ValueError("the sketches are sized for similarities of 80 percent and more")
    rows = stored(_sketched(docs, id_col, text_col, width), "near-sketches")
    # numbers of classes: they are written before they are used, so they stay
    classes = stored(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("id").alias("id"),
            F.min(F.struct(F.coalesce("id", F.lit(0)).alias("at_id"), F.col("text_key").alias("at_text"))).alias("at"),
            F.min(F.struct(F.isnull("id").alias("no_id"), F.col("id"), F.col("text_key"))).alias("least"),
            F.first("size").alias("size"),
            F.first("sketch").alias("sketch"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "digest", "id", "at.at_id", "at.at_text", "least", "size", "sketch"),
        "near-classes",
    )
    lists = stored(_lists(classes), "near-lists")
    passed = stored(_passed(_first_pairs(lists), classes), "near-pairs")
    links = stored(_confirmed(passed, classes, docs, text_col, id_col, width, percent), "near-links")
    mixed_lists = stored(_mixed_lists(lists.where("sets > 2"), links), "near-lists")
    candidates = stored(_candidates(mixed_lists, classes), "near-candidates")
    more = stored(_tile_links(candidates, mixed_lists, classes, docs, id_col, text_col, width, percent), "near-links")
    return rows, classes, components(links.union(more), "near-components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; at least ``percent`` (80 or more) links."""
    rows, classes, linked = _grouped(docs, width, percent, id_col, text_col)
    named = linked.join(classes.select("node", "id"), "node")
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    grouped = named.join(ids, "component").select("node", "component_id")
    by_class = stored(classes.select("node", "digest", F.col("id").alias("own")).join(grouped, "node", "left").select("digest", F.coalesce("component_id", "own").alias("component_id")), "near-results")
    alone = rows.where("digest is null").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return (
        rows.where("digest is not null").join(by_class, "digest")
        .select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id").union(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one of the smallest id (null ids last) and text key; all columns stay.

    Rows are told apart by id and text, so another text of the same id, or
    another row without id, is judged by its own component. Of rows that share
    both, one stays. Rows without shingles are linked with nothing and all stay.
    """
    rows, classes, linked = _grouped(docs.select("doc_id", "text"), width, percent, "doc_id", "text")
    least = classes.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    again = rows.where("digest is not null").groupBy("id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("text_key").alias("again_key"))
    kept = least.select(F.col("least.id").alias("kept_id"), F.col("least.text_key").alias("kept_key"))
    kept = stored(kept.join(again, F.col("kept_id").eqNullSafe(F.col("again_id")) & (F.col("kept_key") == F.col("again_key")), "left").select("kept_id", "kept_key", F.isnotnull("again_key").alias("several")), "near-kept")
    # a table of its own, so that its size is known and a small one is sent around
    several = stored(kept.where("several").select("kept_id", "kept_key"), "near-several")
    blank = rows.where("digest is null").select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    single = kept.where("not several").select("kept_id", "kept_key").union(blank)
    # the rows travel in one column, so none of their names meets one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key("text").alias("own_key"))
    here = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    alone = keyed.join(single, here, "left_semi")
    first = keyed.join(several, here, "left_semi").dropDuplicates(["own_id", "own_key"])
    return alone.union(first).select("row.*")
