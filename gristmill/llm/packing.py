"""Hierarchical packing of documents into training sequences.

Each task packs the documents it holds; nothing is shuffled. A document's ids
are cut into full windows of the largest size, and its rest is routed to the
tier of the smallest window that holds it. Tiers are packed from the largest
to the smallest: the longest piece opens a window, the gap is filled by the
longest piece of the same or a shorter tier that fits, and where none fits by a
part cut from the shortest piece there is. So every window is full but the last
of a task, which is padded to the largest size. Full windows have a power of
two of ids and need no padding. Sequences are dealt, largest first, into step
groups of ``step_ids`` ids; what doesn't fill a group waits for the task's next
sequences. What is left of all tasks, less than a group of each, is dealt out
together: windows are powers of two, so in falling order a running sum of ids cuts
them into whole groups. All step groups have the same size but the last one of all.

Null texts are empty (the end id alone). Rows with null or repeated doc_ids are
packed as documents of their own, other columns are left out, and an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored
from gristmill.llm.encoding import Encoder
from gristmill.llm.scans import running

WINDOWS = (256, 512, 1024, 2048)
END_ID = 1
STEP_IDS = 32_768
#: Ids that a task holds before it packs them.
BUFFER_IDS = 2_000_000
#: Where the numbers of step groups over several tasks begin.
LEFT = 1 << 62
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " window int, step_group long"
)


class Packer:
    """Packs numbered documents; ``sizes`` and pieces are (row, start, length)."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS, step_ids: int = STEP_IDS):
        self.windows, self.step_ids = sorted(windows), step_ids
        #: For each tier the pieces that wait, as (length, row, start), ascending.
        self.tiers: list[list[tuple[int, int, int]]] = [[] for _ in self.windows]
        self.sequences: list[tuple[int, list[tuple[int, int, int]]]] = []

    def _tier(self, length: int) -> int:
        return next(k for k, w in enumerate(self.windows) if length <= w)

    def add(self, row: int, size: int) -> None:
        largest, start = self.windows[-1], 0
        while size - start >= largest:
            self.sequences.append((largest, [(row, start, largest)]))
            start += largest
        if size > start:
            self.tiers[self._tier(size - start)].append((size - start, row, start))

    def _fill(self, gap: int, most: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of a tier up to ``most`` that fits, else a part of the shortest one."""
        best = None
        for k in range(most, -1, -1):
            at = bisect_right(self.tiers[k], (gap, float("inf"), 0))
            if at and (best is None or self.tiers[k][at - 1][0] > best[0]):
                best = (self.tiers[k][at - 1][0], k, at - 1)
        if best:
            return self.tiers[best[1]].pop(best[2])
        for tier in self.tiers[: most + 1]:
            if tier:
                length, row, start = tier.pop(0)
                rest = (length - gap, row, start + gap)
                insort(self.tiers[self._tier(rest[0])], rest)
                return gap, row, start
        return None

    def flush(self, last: bool) -> Iterator[tuple[int, int | None, list[tuple[int, int, int]]]]:
        """(window, step, pieces) of the full sequences that fill step groups; with ``last`` of all there are, those beyond with step None."""
        for tier in self.tiers:
            tier.sort()
        short: list[tuple[int, int, int]] = []
        for k in range(len(self.windows) - 1, -1, -1):
            window = self.windows[k]
            while self.tiers[k]:
                length, row, start = self.tiers[k].pop()
                pieces, gap = [(row, start, length)], window - length
                while gap and (found := self._fill(gap, k)):
                    pieces.append((found[1], found[2], found[0]))
                    gap -= found[0]
                if gap:
                    short += pieces
                else:
                    self.sequences.append((window, pieces))
        if short and not last:
            for row, start, length in short:
                self.tiers[self._tier(length)].append((length, row, start))
        elif short:
            self.sequences += [(self.windows[-1], p) for p in _filled(short, self.windows[-1])]
        # largest first, so that no sequence reaches over the end of a group
        self.sequences.sort(key=lambda s: -s[0])
        groups, used = sum(w for w, _ in self.sequences) // self.step_ids, 0
        waiting = []
        for window, pieces in self.sequences:
            if used // self.step_ids < groups:
                yield window, used // self.step_ids, pieces
            elif last:
                yield window, None, pieces
            else:
                waiting.append((window, pieces))
            used += window
        self.sequences = waiting


def _filled(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces one after another, cut at windows."""
    now, room = [], window
    for row, start, length in pieces:
        while length:
            take = min(length, room)
            now.append((row, start, take))
            start, length, room = start + take, length - take, room - take
            if not room:
                yield now
                now, room = [], window
    if now:
        yield now


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    windows: tuple[int, ...] = WINDOWS,
    end_id: int = END_ID,
    step_ids: int = STEP_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: where it comes from, where it lies, and the crc32 of its ids."""
    names = [c.split()[0] for c in SCHEMA.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        packer, held, waiting, next_row, sequence, step = Packer(windows, step_ids), {}, 0, 0, first, first

        def out(last: bool) -> pa.RecordBatch:
            nonlocal sequence, step
            rows, top = [], step - 1
            for window, group, pieces in packer.flush(last):
                offset, own = 0, None if group is None else step + group
                top = top if own is None else own
                for row, start, length in pieces:
                    doc_id, ids = held[row]
                    rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, window, own))
                    offset += length
                sequence += 1
            step = top + 1
            left = {p[1] for tier in packer.tiers for p in tier} | {p[0] for _, pieces in packer.sequences for p in pieces}
            for row in [r for r in held if r not in left]:
                del held[row]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "window" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                held[next_row] = doc_id, ids
                packer.add(next_row, len(ids) // 4)
                next_row += 1
                waiting += len(ids) // 4
                if waiting >= BUFFER_IDS:
                    yield out(False)
                    waiting = 0
        yield out(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = stored(rows.mapInArrow(run, SCHEMA), "packed-pieces")
    # a task leaves less than a group, so these are few rows a task
    left = packed.where("step_group is null").groupBy("sequence_id").agg(F.first("window").cast("long").alias("ids")).withColumn("all", F.lit(0))
    placed = running(left, "all", [F.col("ids").desc(), F.col("sequence_id")], sums=["ids"], name="packed-left")
    groups = placed.select("sequence_id", (F.floor((F.col("running_ids") - F.col("ids")) / step_ids) + LEFT).cast("long").alias("own"))
    return packed.join(groups, "sequence_id", "left").select(*names[:-1], F.coalesce("step_group", "own").alias("step_group"))
