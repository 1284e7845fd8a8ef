"""Near-duplicate vectors by product quantisation.

Equal vectors form one class first. A bounded sample of classes fits coarse
centroids and, for what is left after them, a codebook for each of ``PARTS``
subspaces. There are as many lists as hold about ``LIST`` classes each; beyond
``FIRST`` of them a second set of centroids, shared by all, parts each list by
what is left after the first. Every class is then encoded: its list, its codes,
and how far the codes are from the vector. Each class also asks: it probes every
list whose border with its own is near enough that a link may cross it, looks up
asymmetric distances (its exact remainder against codes) in tables, and compares
exactly, in double precision, whatever the codes don't rule out. The codes only
rule out what the triangle inequality proves too far, so the one loss is in the
probes. A link is found if either end probes the other's list, and counts for
both; the loss is measured in the tests.

Members and questions meet by list. A list of many members is cut into blocks,
and its questions are dealt into portions, so that a task holds ``BLOCK``
members and ``PORTION`` questions at a time. Tasks give out numbers of links and,
in place of all pairs, each class's smallest class within the block.

Vectors of each length are searched by themselves; a length that the sample
doesn't hold is rare, and all its vectors form one list, compared in blocks.
Vectors that are null, zero, or with null or non-finite components are linked
with nothing. Equal vectors are linked with each other and share their links.
Rows with null or repeated ids are vectors of their own, except that equal
vectors under one null or repeated id are counted as rows; a component's id is
its smallest that is not null. Other columns are left out; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gristmill.llm.common import components, stored, whole_groups

MIN_COSINE = 0.9
#: Classes that the fit reads at most.
SAMPLE = 20_000
PARTS, CODES = 8, 256
#: Classes a list is meant to hold, and lists that one set of centroids makes.
LIST, FIRST = 200, 1024
#: A probe reaches this many standard deviations of a link's length across a border.
REACH = 1.5
BLOCK, PORTION = 1024, 2048
ROUNDS = 6
#: Numbers of lists carry the vectors' length above these bits.
LENGTH_BITS = 40
#: Distances to second centroids that are held at a time.
AT_ONCE = 1_000_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def k_means(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    n = (centres * centres).sum(1)
    return np.sqrt(np.maximum(n[:, None] + n[None] - 2 * centres @ centres.T, 1e-24))


def _across(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """(row, centroid): how far a row lies from the border between its nearest centroid and this one."""
    d2 = (centres * centres).sum(1) - 2 * x @ centres.T
    own = d2.argmin(1)
    return (d2 - d2[np.arange(len(x)), own][:, None]) / (2 * gaps[own])


@dataclass
class Quantiser:
    """Coarse centroids of one or two levels, and the codebooks of what they leave."""

    centres: np.ndarray
    seconds: np.ndarray
    #: A codebook a subspace; subspaces are ranges of dimensions.
    books: list[np.ndarray]
    spans: list[tuple[int, int]]
    gaps: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES, seed: int = 3, first: int = FIRST) -> Quantiser:
        r = np.random.default_rng(seed)
        centres = k_means(x, min(lists, first), r)
        rest = x - centres[_nearest(x, centres)]
        more = -(-lists // len(centres))
        seconds = k_means(rest, more, r) if more > 1 else np.zeros((1, x.shape[1]))
        rest = rest - seconds[_nearest(rest, seconds)]
        edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
        spans = list(zip(edges, edges[1:], strict=False))
        return cls(centres, seconds, [k_means(rest[:, a:b], codes, r) for a, b in spans], spans)

    @classmethod
    def single(cls, width: int) -> Quantiser:
        """One list, whose codes tell nothing."""
        zero = np.zeros((1, width))
        return cls(zero, zero, [zero], [(0, width)])

    def _home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        second = _nearest(rest, self.seconds)
        return own * len(self.seconds) + second, rest - self.seconds[second]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes (row, part), and distances between vectors and what their codes stand for."""
        own, rest = self._home(x)
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)], 1)
        back = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, least: float, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that a row may have links in, its own among them.

        Two vectors of cosine ``least`` differ, at right angles to the first, by
        sqrt(1 - least^2). Across a border between two lists that is, in any
        direction, a standard deviation of sqrt(dimensions) times less;
        ``reach`` of them are allowed for, over both levels together.
        """
        if not self.gaps:
            self.gaps = [_gaps(self.centres), _gaps(self.seconds)]
        most = reach * np.sqrt((1 - least * least) / x.shape[1])
        first = _across(x, self.centres, self.gaps[0])
        row, at = np.nonzero(first <= most)
        n = len(self.seconds)
        if n == 1:
            return row, at
        out = []
        for k in range(0, len(row), step := max(1, AT_ONCE // n)):
            r, a = row[k : k + step], at[k : k + step]
            second = _across(x[r] - self.centres[a], self.seconds, self.gaps[1])
            p, b = np.nonzero(second**2 + first[r, a][:, None] ** 2 <= most**2)
            out.append((r[p], a[p] * n + b))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For questions of list ``at``: squared distances (row, code) a subspace."""
        rest = x - self.centres[at // len(self.seconds)] - self.seconds[at % len(self.seconds)]
        return [((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book * book).sum(1)) for (a, b), book in zip(self.spans, self.books, strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(quantiser: Quantiser, at: int, questions: np.ndarray, members: np.ndarray, codes: np.ndarray, error: np.ndarray, least: float) -> np.ndarray:
    """(question, member) flags of cosines of at least ``least``."""
    far = np.zeros((len(questions), len(members)))
    for p, table in enumerate(quantiser.tables(questions, at)):
        far += table[:, codes[:, p]]
    # |q - x| >= |q - code of x| - |x - code of x|
    q, m = np.nonzero(np.sqrt(np.maximum(far, 0)) - error <= np.sqrt(2 - 2 * least) + 1e-9)
    out = np.zeros(far.shape, bool)
    for k in range(0, len(q), 100_000):
        a, b = q[k : k + 100_000], m[k : k + 100_000]
        out[a, b] = np.einsum("ij,ij->i", questions[a], members[b]) >= least
    return out


def block_labels(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows a and columns b of ``links``: the smallest id that each reaches within the block."""
    a, b = a.copy(), b.copy()
    x, y = np.nonzero(links)
    while True:
        before = a.copy()
        np.minimum.at(b, y, a[x])
        np.minimum.at(a, x, b[y])
        if (a == before).all():
            return a, b


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id, and the vector as bytes, null where it can't be linked; and how its numbers are held."""
    kind = rows.schema[vector_col].dataType
    held = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(held)
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vector"])

    values = F.col(vector_col) if held == "<f4" else F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), values.alias("v")).mapInArrow(run, "id long, vector binary"), held


def _unit_rows(vectors: list[bytes], held: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vectors), held).reshape(len(vectors), -1).astype(float))


def fit_quantisers(classes: DataFrame, held: str, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """A quantiser for each length among at most ``sample`` classes, chosen by a hash of the vector."""
    n, chosen = classes.count(), [bytes(r[0]) for r in classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()]
    size, out = np.dtype(held).itemsize, {}
    for width in sorted({len(v) // size for v in chosen}):
        x = _unit_rows([v for v in chosen if len(v) == width * size], held)
        out[width] = Quantiser.fit(x, max(1, round(n * len(x) / len(chosen) / LIST)))
    return out


INDEX = "list long, node long, rows long, vector binary, codes binary, error double"
QUESTIONS = "list long, home long, node long, rows long, vector binary"
FOUND = "node long, n long, label long"


def near_vectors(rows: DataFrame, least: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = rows.sparkSession
    vectors, kind = _vectors(rows, id_col, vector_col)
    held = stored(vectors, "vectors")
    grouped = held.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    # numbers of classes: they are written before they are used, so they stay
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    shared = spark.sparkContext.broadcast(fit_quantisers(classes, kind))
    item = np.dtype(kind).itemsize

    def quantiser(width: int) -> Quantiser:
        return shared.value.get(width) or Quantiser.single(width)

    def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """(length, its rows, their unit vectors)."""
        lengths = np.diff(np.frombuffer(batch.column(at).buffers()[1], np.int32)[batch.column(at).offset :][: batch.num_rows + 1]) // item
        for width in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == width))
            yield width, part, _unit_rows(part.column(at).to_pylist(), kind)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, x in by_length(batch, 2):
                own, codes, error = quantiser(width).encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(own + (width << LENGTH_BITS)), *part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["list", "node", "rows", "vector", "codes", "error"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, x in by_length(batch, 3):
                row, at = quantiser(width).probes(x, least)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(at + (width << LENGTH_BITS)), *(c.take(row) for c in part.columns)], ["list", "home", "node", "rows", "vector"])

    index = stored(classes.select("node", "rows", "vector").mapInArrow(encode, INDEX), "vector-index")
    questions = stored(index.select(F.col("list").alias("home"), "node", "rows", "vector").mapInArrow(ask, QUESTIONS), "vector-questions")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    loads = questions.groupBy("list").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    # lists that are cut only; the table is written, so Spark joins it by its size
    spread = stored(sizes.join(loads, "list").where("blocks > 1 or portions > 1"), "vector-spread")
    blocks, portions = F.coalesce("blocks", F.lit(1)), F.coalesce("portions", F.lit(1))
    left = (
        index.join(spread, "list", "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("portion", F.explode(F.sequence(F.lit(0), portions - 1)))
        .select("list", "block", "portion", F.lit(0).alias("side"), F.col("list").alias("home"), "node", "rows", "vector", "codes", "error")
    )
    right = (
        questions.join(spread, "list", "left")
        .withColumn("portion", F.pmod(F.xxhash64("node"), portions).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("list", "block", "portion", F.lit(1).alias("side"), "home", "node", "rows", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["list", "block", "portion"]):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                number, n = part.column("list")[0].as_py(), int((part.column("side").to_numpy() == 0).sum())
                if n in (0, part.num_rows):
                    continue
                quant, base = quantiser(number >> LENGTH_BITS), number >> LENGTH_BITS << LENGTH_BITS
                node, mass, home = (part.column(c).to_numpy() for c in ("node", "rows", "home"))
                x = _unit_rows(part.column("vector").to_pylist(), kind)
                codes = np.frombuffer(b"".join(part.column("codes").slice(0, n).to_pylist()), np.uint8).reshape(n, -1)
                links = linked(quant, number - base, x[n:], x[:n], codes, part.column("error").to_numpy()[:n], least)
                links &= node[n:, None] != node[None, :n]
                asks, has = block_labels(links, node[n:], node[:n])
                total = np.concatenate([np.zeros(n, np.int64), links @ mass[:n]])
                # a member that doesn't probe the question's list won't find this link itself
                q, m = np.nonzero(links & (home[n:] != number)[:, None])
                if len(q):
                    members, back = np.unique(m, return_inverse=True)
                    row, at = quant.probes(x[members], least)
                    key = lambda r, k: (r << np.int64(LENGTH_BITS)) + k
                    unasked = ~np.isin(key(back, home[n:][q] - base), key(row, at))
                    np.add.at(total, m[unasked], mass[n:][q[unasked]])
                labels = np.concatenate([has, asks])
                told = (total > 0) | (labels != node)
                yield pa.RecordBatch.from_arrays([pa.array(z[told]) for z in (node, total, labels)], ["node", "n", "label"])

    together = left.union(right).repartition("list", "block", "portion").sortWithinPartitions("list", "block", "portion", "side")
    found = stored(together.mapInArrow(compare, FOUND), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "vector-components")
    named = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_vector = stored(
        named.join(ids, "component").join(counts, "node", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id"),
        "vector-results",
    )
    alone = held.where("vector is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return held.where("vector is not null").join(by_vector, "vector").select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    ).union(alone)
