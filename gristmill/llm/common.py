"""Small helpers that the corpus operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many characters, so that a
#: task's memory does not follow the rows of an Arrow batch.
SLICE_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    everything runs on one machine, a temporary folder takes its place; on a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='gristmill-')}")
        where = context.getCheckpointDir()
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there.

    The shuffle files behind the written table are dropped, as nothing reads
    them again.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`stored` gave and nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if path.toString().startswith(shared_dir(spark)):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts add up to about ``most`` characters; one long text is a range."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def per_text(
    df: DataFrame,
    id_col: str | list[Column],
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[list, list[str]], list | pa.RecordBatch]],
) -> DataFrame:
    """Apply a function to (ids, texts) slices; only the columns named are read.

    ``make`` runs once a task and gives the function, so that models and
    vocabularies are loaded once. Null texts arrive as empty ones. Of several
    id columns the function gets a tuple a row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            ids, texts = columns[0] if len(columns) == 2 else list(zip(*columns[:-1], strict=True)), columns[-1]
            for a, b in slices(texts):
                got = work(ids[a:b], [t or "" for t in texts[a:b]])
                if isinstance(got, pa.RecordBatch):
                    yield got
                elif got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow
                    )

    ids = [F.col(id_col).cast("long").alias("id")] if isinstance(id_col, str) else id_col
    return df.select(*ids, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def per_row(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], tuple[list[bool], list | None]]]) -> DataFrame:
    """Keep or rewrite whole rows by their text; every column travels along.

    The function gives for a slice of texts a keep flag each and, if texts
    change, the new ones (None in its place leaves a text as it is).
    """
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                keep, new = work([t or "" for t in texts[a:b]])
                if new is not None:
                    column = pa.array([o if n is None else n for o, n in zip(texts[a:b], new, strict=True)], part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), column)
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; a bounded number is remembered."""

    def __init__(self, most: int = 1_000_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def text_key(text_col: str = "text") -> Column:
    """Beside an id, tells rows apart that share it."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts, of batches sorted by integer ``keys``."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads every bit of the input over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of every run of ``n`` neighbours in ``h``."""
    out = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) and the smallest node it reaches.

    Alternating star contraction: every node first points its larger, then its
    smaller neighbours at the smallest one known, until nothing changes. The
    links stay in Spark; each round is a written table.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        ).distinct()
        links, done = stored(small, name), links
        discarded(done)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0, F.lit(False))
