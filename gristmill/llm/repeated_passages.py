"""Repeated passages, found exactly by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the run of
``SEED`` words in it with the smallest hash (the first such run), so equal
windows have equal minimisers. Consecutive windows with the same minimiser make
a super-k-mer, which travels as one packed string to its minimiser's bucket. A
bucket is sorted, and its windows are counted as strings of words, exactly.

Two things keep the shuffles small. Minimisers are counted first, as bare
numbers, and only super-k-mers whose minimiser occurs again are packed. Equal
packed strings are added up before they are sent, and their places join the
bucket's findings by a 128-bit digest instead of travelling with the string. A
minimiser with more than ``HOT`` super-k-mers (a line that a third of all texts
holds) deals its windows out one by one over ``SPLITS`` buckets by their digest;
equal windows still meet, so counts stay exact.

Null, empty and short texts have no windows and lose nothing. Rows that repeat
each other count as often as they occur; rows with null or repeated ids are
texts of their own. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import WordHashes, mixed, per_text, run_hashes, stored, text_key, whole_groups

WINDOW, SEED = 35, 6
HOT, SPLITS = 20_000, 4096
#: Hot minimisers are broadcast up to this many (8 bytes each); beyond it, keys are salted.
MOST_HOT, SALTS = 500_000, 16


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def super_kmers(texts: list[list[bytes]], hashes: WordHashes, window: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first words, window counts, minimiser hashes) of each text with windows."""
    h = hashes.of([w for ws in texts for w in ws])
    if len(h) < window:
        return
    seeds = mixed(run_hashes(h, seed)).view(np.int64)
    at = 0
    for i, ws in enumerate(texts):
        n = len(ws) - window + 1
        if n > 0:
            own = seeds[at : at + len(ws) - seed + 1]
            views = np.lib.stride_tricks.sliding_window_view(own, window - seed + 1)
            lowest = views.argmin(1) + np.arange(n)
            first = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
            yield i, first, np.diff(np.append(first, n)), own[lowest[first]]
        at += len(ws)


def _entries(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> DataFrame:
    """One row a super-k-mer, without its words."""

    def make():
        hashes = WordHashes()

        def work(ids, texts):
            rows, starts, counts, values = [], [], [], []
            for i, first, n, value in super_kmers([split_words(t) for t in texts], hashes, window, seed):
                rows.append(np.full(len(first), i))
                starts.append(first)
                counts.append(n)
                values.append(value)
            if not rows:
                return []
            at = pa.array(np.concatenate(rows))
            a, b = (pa.array([x[k] for x in ids], pa.int64()).take(at) for k in (0, 1))
            numbers = [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, counts)]
            return pa.RecordBatch.from_arrays([a, b, *numbers, pa.array(np.concatenate(values))], ["at_id", "at_text", "start", "windows", "minimiser"])

        return work

    return per_text(docs, _place(id_col, text_col), text_col, "at_id long, at_text long, start int, windows int, minimiser long", make)


def _place(id_col: str, text_col: str):
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("at_id"), text_key(text_col).alias("at_text")]


def _digest(packed: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(packed, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


PACKED = "minimiser long, part int, k1 long, k2 long, at_id long, at_text long, start int, packed binary"


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """The packed strings of each text's super-k-mers that may repeat; of hot minimisers, its single windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at_id, at_text, text, kmers = (batch.column(k)[r].as_py() for k in range(4))
                words, rows = split_words(text or ""), []
                for x in kmers:
                    a, n = x["start"], x["windows"]
                    if x["hot"]:
                        for i in range(a, a + n):
                            packed = b" ".join(words[i : i + window])
                            k1, k2 = _digest(packed)
                            rows.append((x["minimiser"], k1 % SPLITS, k1, k2, at_id, at_text, i, packed))
                    else:
                        packed = b" ".join(words[a : a + n + window - 1])
                        rows.append((x["minimiser"], 0, *_digest(packed), at_id, at_text, a, packed))
                yield _batch(rows, PACKED)

    return texts.mapInArrow(run, PACKED)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])


def repeated_in_bucket(strings: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each packed string, the numbers of its windows that occur again; ``strings`` has how often each string occurs."""
    if len(strings) == 1:
        ((packed, n),) = strings.items()
        return {packed: list(range(packed.count(b" ") + 2 - window))} if n > 1 else {}
    windows = []
    for packed, n in strings.items():
        ends = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
        windows += [(packed[ends[i] + 1 : ends[i + window]], packed, i, n) for i in range(len(ends) - window)]
    windows.sort()
    out: dict[bytes, list[int]] = {}
    for _, same in groupby(windows, key=lambda w: w[0]):
        same = list(same)
        if sum(n for *_, n in same) > 1:
            for _, packed, i, _ in same:
                out.setdefault(packed, []).append(i)
    return out


FOUND = "k1 long, k2 long, offsets array<int>"


def _found(packed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, numbers of the repeated windows) of each distinct string that has any."""

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            yield _batch([(*k, n) for k, n in counts.items()], "minimiser long, part int, packed binary, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["minimiser", "part"]):
            strings, counts, out = table.column("packed").to_pylist(), table.column("n").to_pylist(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if b - a == 1 and counts[a] == 1:
                    continue
                bucket: dict[bytes, int] = {}
                for k in range(a, b):
                    bucket[strings[k]] = bucket.get(strings[k], 0) + counts[k]
                out += [(*_digest(s), sorted(o)) for s, o in repeated_in_bucket(bucket, window).items()]
            yield _batch(out, FOUND)

    counted = packed.select("minimiser", "part", "packed").mapInArrow(added, "minimiser long, part int, packed binary, n long")
    return counted.repartition("minimiser", "part").sortWithinPartitions("minimiser", "part").mapInArrow(run, FOUND)


def _recurring(entries: DataFrame, again: DataFrame) -> DataFrame:
    """The entries whose minimiser occurs again, and whether it is hot.

    A hot minimiser may hold a third of all entries, so these are told where they
    are, by a broadcast of the hot ones, and don't meet in one task. If there are
    more than ``MOST_HOT`` of them, entries are dealt over ``SALTS`` parts of each key.
    """
    hot = again.where("hot").select("minimiser")
    n = hot.count()
    if not n:
        return entries.join(again, "minimiser")
    if n > MOST_HOT:
        salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = entries.withColumn("salt", F.pmod(F.xxhash64("at_id", "at_text", "start"), F.lit(SALTS)).cast("int"))
        return dealt.join(salted, ["minimiser", "salt"]).drop("salt")
    listed = F.broadcast(hot)
    others = entries.join(listed, "minimiser", "left_anti").join(again.where("not hot"), "minimiser")
    return entries.join(listed, "minimiser").withColumn("hot", F.lit(True)).unionByName(others)


def _marks(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, hot: int) -> DataFrame:
    """(at_id, at_text, starts): the repeated windows' first words of each text that has any."""
    entries = stored(_entries(docs, id_col, text_col, window, seed), "passage-minimisers")
    counts = entries.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(counts.select("minimiser", (F.col("n") > hot).alias("hot")), "passage-recurring")
    kmers = F.collect_set(F.struct("start", "windows", "minimiser", "hot")).alias("kmers")
    flagged = stored(_recurring(entries, again).groupBy("at_id", "at_text").agg(kmers), "passage-candidates")
    texts = docs.select(*_place(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    packed = stored(_packed(texts.join(flagged, ["at_id", "at_text"]).select("at_id", "at_text", "text", "kmers"), window), "passage-super-kmers")
    found = stored(_found(packed, window), "passage-repeats")
    places = packed.select("k1", "k2", "at_id", "at_text", "start").join(found, ["k1", "k2"])
    starts = F.flatten(F.collect_set(F.transform("offsets", lambda o: o + F.col("start"))))
    return stored(places.groupBy("at_id", "at_text").agg(starts.alias("starts")), "passage-marks")


def kept_words(words: list[bytes], starts: list[int] | None, window: int) -> list[bytes]:
    if not starts:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.unique(starts)
    gone[at] += 1
    np.subtract.at(gone, np.minimum(at + window, len(words)), 1)
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and the text that is left (with ``digest``, its SHA-256 instead)."""
    marks = _marks(docs, id_col, text_col, window, seed, hot)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_place(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(marks, ["at_id", "at_text"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                doc_id, text, starts = (batch.column(k)[r].as_py() for k in range(3))
                words = split_words(text or "")
                left = kept_words(words, starts, window)
                kept = b" ".join(left)
                out.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")))
            yield _batch(out, KEPT)

    done = rows.mapInArrow(run, KEPT)
    return done.withColumnRenamed("kept_text", "kept_sha256") if digest else done
