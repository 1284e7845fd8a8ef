"""Benchmark decontamination by greedy string tiling.

Words (letters and digits, lower case) of benchmark items and documents are
compared. A document is a candidate for an item if they share a seed of
``MIN_MATCH`` words; the seeds of a bounded block of items are held as sorted
hashes, so the documents are read once a block and never shuffled. For each
candidate pair all maximal matches are found by Karp-Rabin fingerprints; the
longest is marked as a tile, again and again, and of a match that tiles partly
cover, what is left of ``MIN_MATCH`` words or more waits for its turn. So the next
tile is always the longest free match. Tiles may lie in any order, so passages
that were moved around are found too. The share of an item's words under tiles
is its coverage; from ``coverage`` on the document is contaminated.

Benchmarks of any size are worked through in blocks of at most ``BLOCK_CHARS``
characters (at least one item), each of which is broadcast. Null or empty items
and documents match nothing, items shorter than a seed must occur whole, null
or repeated ids are rows like any other, empty tables give no rows, and other
columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import per_row, per_text, run_hashes

WORD = re.compile(r"[^\W_]+")
MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 8_000_000
FOUND = "doc_id long, item long, item_words long, covered_words long, tiles long, coverage double, contaminated boolean"
PAIRS = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double, contaminated boolean"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def greedy_tiles(item: list[int], doc: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length), none of which overlap.

    Word number 0 stands for a word that occurs in no item and matches nothing.
    """
    least = max(1, min(least, len(item)))
    free_item, free_doc = [True] * len(item), [True] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, least - 1, mod)

    def prints(seq: list[int]) -> Iterator[tuple[int, int]]:
        """(fingerprint, start) of each run of known words, rolled on word by word."""
        value = run = 0
        for i, x in enumerate(seq):
            if not x:
                value = run = 0
                continue
            if run >= least:
                value -= seq[i - least] * top
            value = (value * base + x) % mod
            run += 1
            if run >= least:
                yield value, i - least + 1

    at = defaultdict(list)
    for value, i in prints(item):
        at[value].append(i)
    # a heap of all maximal matches, the longest first
    matches = []
    for value, j in prints(doc):
        for i in at.get(value, ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue  # part of a match that starts before
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            if n >= least:
                matches.append((-n, i, j))
    heapify(matches)
    while matches:
        n, i, j = heappop(matches)
        runs, start = [], None
        for k in range(-n + 1):
            free = k < -n and free_item[i + k] and free_doc[j + k]
            if free and start is None:
                start = k
            elif not free and start is not None:
                runs.append((start, k))
                start = None
        if runs == [(0, -n)]:
            tiles.append((i, j, -n))
            free_item[i : i - n] = free_doc[j : j - n] = [False] * -n
            continue
        # tiles cover some of it: what they leave waits for its turn
        for first, last in runs:
            if last - first >= least:
                heappush(matches, (first - last, i + first, j + first))
    return tiles


class Block:
    """A bounded block of benchmark items with the hashes of its seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_MATCH):
        self.least, self.ids, self.number, self.items = least, [], {}, []
        for item_id, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")]
            if seq:
                self.ids.append(item_id)
                self.items.append(seq)
        seeds = defaultdict(list)
        for k, seq in enumerate(self.items):
            n = min(least, len(seq))
            for i, h in enumerate(run_hashes(np.array(seq, np.uint64), n).tolist()):
                seeds[n, h].append((k, i))
        self.seeds = dict(seeds)
        self.sorted = {n: np.array(sorted(h for m, h in seeds if m == n), np.uint64) for n in {m for m, _ in seeds}}

    def matches(self, text: str, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item, its words, words under tiles, tiles) of each item covered to ``coverage``."""
        if not self.items:
            return []
        found = words(text)
        doc = np.fromiter(map(self.number.get, found, repeat(0)), np.int64, len(found))
        known = doc > 0
        touched: dict[int, set[int]] = defaultdict(set)
        for n, have in self.sorted.items():
            if len(doc) < n:
                continue
            counts = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(counts[n:] - counts[:-n] == n)
            if not len(at):
                continue
            h = run_hashes(doc.astype(np.uint64), n)[at]
            k = np.searchsorted(have, h)
            k[k == len(have)] = 0
            for x in np.unique(h[have[k] == h]).tolist():
                for item, i in self.seeds[n, x]:
                    touched[item].update(range(i, i + n))
        out, seq = [], None
        for item, under in sorted(touched.items()):
            size = len(self.items[item])
            if len(under) < coverage * size:
                continue  # tiles lie within shared seeds, so coverage can't be reached
            seq = seq or doc.tolist()
            tiles = greedy_tiles(self.items[item], seq, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * size:
                out.append((self.ids[item], size, covered, len(tiles)))
        return out


def blocks(benchmark: DataFrame, text_col: str = "text", most: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark's different texts in blocks of about ``most`` characters at most, dealt by their hash, which names them."""
    rows = benchmark.select(F.col(text_col).cast("string").alias("text")).where("text is not null").distinct().withColumn("item", F.xxhash64("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * chars // most)) if chars > most else 1
    for k in range(n):
        part = rows.where(F.pmod("item", F.lit(n)) == k).orderBy("item", "text")
        yield Block([(r["item"], r["text"]) for r in part.collect()])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(document, item) pairs whose coverage reaches the threshold; items of one text are looked for once."""
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            held = shared.value

            def work(ids, texts):
                return [(d, i, n, c, k, c / n, True) for d, t in zip(ids, texts, strict=True) for i, n, c, k in held.matches(t, coverage)]

            return work

        found = per_text(docs, id_col, text_col, FOUND, make)
        out = found if out is None else out.union(found)
    items = benchmark.select(F.xxhash64(F.col(text_col).cast("string")).alias("item"), F.col(item_col).cast("long").alias("item_id")).where(F.col(text_col).isNotNull())
    return out.join(items, "item").select(*[c.split()[0] for c in PAIRS.split(", ")])


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            held = shared.value
            return lambda texts: ([not held.matches(t, coverage) for t in texts], None)

        docs = per_row(docs, text_col, make)
    return docs
