"""Token ids in ORC files: one row a document, in ascending id order.

The files use what ORC itself offers: integer columns are run-length encoded,
every stripe has row indexes, and document ids have Bloom filters besides their
minima and maxima, so that a lookup reads few stripes and a scan reads stripes
in parallel.

Texts are encoded where they are read, so only ids are shuffled, in two bytes
each where the vocabulary allows. Each file takes
a range of doc_ids; the bounds are quantiles of the ids alone. An id that holds
several files' share of the rows (null counts as one) is spread over as many by
a hash of the text. ``start_in_file`` counts ids within a file; what the files
before it hold is one number a file, in a small table beside the files.

Null texts are empty: such a document holds the end id alone. Rows with a null
doc_id come first. Rows that share a doc_id are documents of their own next to
each other, in the order of their texts' hashes, then of their ids. Other columns
are left out, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import shared_path, slices, text_key
from gristmill.llm.encoding import Encoder

END_ID = 2
SCHEMA = "shard int, doc_id long, start_in_file long, n_tokens long, ids array<int>"
ENCODED = "shard int, doc_id long, key long, packed binary"
#: Null ids sort first; quantiles see them as the smallest number.
NO_ID = np.iinfo(np.int64).min
STRIPE_BYTES = 4 << 20
#: Rows that are unpacked at a time.
ROWS = 256


def _bounds(docs: DataFrame, id_col: str, files: int) -> np.ndarray:
    """Ascending ids that part the rows into ``files`` about equal ranges; a frequent id occurs as often as it fills files."""
    at = [(k + 1) / files for k in range(files - 1)]
    if not at:
        return np.zeros(0, np.int64)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"))
    found = ids.agg(F.percentile_approx("id", at, max(10_000, 20 * files)).alias("q")).first().q
    return np.array(found or [], np.int64)


def shards(bounds: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The file of each row: never smaller for a larger (id, key)."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    spread = (keys.astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1)
    return np.minimum(low + spread.astype(np.int64), high).astype(np.int32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode ``docs`` and write the ids to ``files`` ORC files (as many as shuffle partitions, if None) under ``path``."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, id_col, files)
    # the type alone goes to the tasks that write, which need no tokenizer
    kind = Encoder.of(tokenizer).id_type

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            shard = shards(bounds, ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False))
            for a, b in slices(texts, 500_000):
                packed = [np.append(np.frombuffer(encoder.ids(t or ""), "<u4"), end_id).astype(kind).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(shard[a:b]), ids.slice(a, b - a), keys.slice(a, b - a), pa.array(packed, pa.binary())], ["shard", "doc_id", "key", "packed"])

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                shard, doc_id, packed = batch.slice(at, ROWS).columns
                values = [np.frombuffer(x, kind) for x in packed.to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])])
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(values).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([shard, doc_id, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), ids], ["shard", "doc_id", "start_in_file", "n_tokens", "ids"])
                start += int(bounds[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        # a scan of a few splits would leave the others idle while it encodes
        rows = rows.repartition(cores)
    (
        rows.mapInArrow(encode, ENCODED)
        .repartitionById(files, "shard")
        .sortWithinPartitions("doc_id", "key", "packed")
        .select("shard", "doc_id", "packed")
        .mapInArrow(unpack, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(f"{path}/ids")
    )
    spark = docs.sparkSession
    # one number a file reaches the driver
    totals = sorted((r.shard, r.n) for r in spark.read.schema(SCHEMA).orc(f"{path}/ids").groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    begins = np.concatenate([[0], np.cumsum([n for _, n in totals])])[:-1].tolist()
    spark.createDataFrame([(k, int(at)) for (k, _), at in zip(totals, begins, strict=True)], "shard int, before long").coalesce(1).write.parquet(f"{path}/offsets")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``: the ids of all documents before, over all files.

    A filter on doc_id reaches the ORC reader, which skips stripes and row
    groups by their ranges and Bloom filters.
    """
    offsets = spark.read.schema("shard int, before long").parquet(f"{path}/offsets")
    rows = spark.read.schema(SCHEMA).orc(f"{path}/ids")
    # a row a file, so this side is small however large the files are
    return rows.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("start_in_file"))


def id_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that were read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            bounds = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to token files in the shared folder, and digest what reads back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return id_digests(read_token_files(spark, path))
