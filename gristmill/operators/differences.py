"""Where two texts differ: sentences first, words only between what both share.

A sentence that stands once in either text is an anchor. Anchors that are neighbours
in both texts are runs, and the heaviest chain of runs that keeps the order of both
splits the pair into gaps. Words are compared within a gap only, by the length of
their longest common subsequence. Words are letters and digits in lower case: spacing,
case and punctuation are no changes.

Spark tells the words of each text; a pair's two texts are one row and are compared
where they lie, so nothing of them is shuffled or stored, and memory follows a pair.

Null texts are empty. A pair without words in either text has no changes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.operators.folds import ended
from gristmill.operators.names import free
from gristmill.operators.places import stretches

WORD = r"[\p{L}\p{N}]+"
SENTENCE_END = r"(?<=[.;:!?])\s+"
FIGURES = ("words", "hunks", "removed", "added", "changed")


def _lines(text: Column) -> Column:
    """The sentences of a text that have words, a line each: its words with a space between."""
    told = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.array_join(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), " "))
    return F.array_join(F.filter(told, lambda s: s != ""), "\n")


def heaviest_chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (i, j, length), ascending in i, the heaviest that ascend in j too."""
    ends: list[int] = []  # j of the last run of a chain, ascending; its weight is more than that of all before
    weights: list[int] = []
    at: list[int] = []
    back = [-1] * len(runs)
    for n, (_, j, length) in enumerate(runs):
        k = bisect_right(ends, j)
        weight = length + (weights[k - 1] if k else 0)
        back[n] = at[k - 1] if k else -1
        end = k
        while end < len(ends) and weights[end] <= weight:
            end += 1
        ends[k:end], weights[k:end], at[k:end] = [j], [weight], [n]
    found, n = [], at[-1] if at else -1
    while n >= 0:
        found.append(runs[n])
        n = back[n]
    return found[::-1]


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one whole number of as many bits as ``a`` has words."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def _chains(runs: DataFrame) -> DataFrame:
    """pair, gap, i, j, n: the heaviest chain of each pair's runs where they lie as rows, numbered from 1."""
    dealt = runs.repartition("pair").sortWithinPartitions("pair", "i").select("pair", F.struct("i", "j", "n").alias("x"))

    def step(held: list, x: dict) -> list:
        held.append((x["i"], x["j"], x["n"]))
        return held

    told = ended(dealt, 1, list, step, lambda held: [{"gap": g, "i": i, "j": j, "n": n} for g, (i, j, n) in enumerate(heaviest_chain(held), 1)], "chain", "array<struct<gap:bigint,i:bigint,j:bigint,n:bigint>>")
    return told.select("pair", F.inline("chain"))


def _single(lines: list[str]) -> dict[str, int]:
    """Lines that stand once, with their places, in order."""
    seen: dict[str, int] = {}
    for i, line in enumerate(lines):
        seen[line] = -1 if line in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def _gaps(a: list[str], b: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """Lines of either side before, between and behind the shared runs."""
    there, runs = _single(b), []
    for line, i in _single(a).items():
        j = there.get(line)
        if j is None:
            continue
        if runs and (i, j) == (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]):
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    x = y = 0
    for i, j, n in [*heaviest_chain(runs), (len(a), len(b), 0)]:
        yield a[x:i], b[y:j]
        x, y = i + n, j + n


def compared(old: str, new: str) -> tuple[int, int, int, int, int]:
    """``FIGURES`` of two texts, told as lines of words."""
    a, b = (t.split("\n") if t else [] for t in (old, new))
    words = max(len(a) + old.count(" "), len(b) + new.count(" "))
    hunks = removed = added = changed = 0
    if old != new:
        for gap in _gaps(a, b):
            x, y = (" ".join(side).split(" ") if side else [] for side in gap)
            same = common_words(x, y) if x and y else 0
            less, more = len(x) - same, len(y) - same
            hunks, removed, added, changed = hunks + (less + more > 0), removed + less, added + more, changed + max(less, more)
    return words, hunks, removed, added, changed


def _compared(told: DataFrame) -> DataFrame:
    """``told`` with ``FIGURES`` in place of its last two columns, the lines of either text; null where these are null."""
    schema = StructType([*told.schema.fields[:-2], *[StructField(f, LongType()) for f in FIGURES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, old, new = batch.columns
            out = [compared(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else (None,) * len(FIGURES) for x, y in zip(old, new, strict=True)]
            figures = list(zip(*out, strict=True)) if out else [()] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(f, pa.int64()) for f in figures]], schema.names)

    return told.mapInArrow(run, schema)


def differences(pairs: DataFrame, keys: Sequence[str], old: str, new: str) -> DataFrame:
    """keys, words, hunks, removed, added, changed.

    ``words`` is the longer text's count. A hunk is a gap that isn't the same on both
    sides; it changes as many words as the larger of what it removes and adds.
    """
    return _compared(pairs.select(*keys, _lines(F.col(old)).alias("old"), _lines(F.col(new)).alias("new")))


def successive(rows: DataFrame, group: str, order: str, text: str, name: str) -> DataFrame:
    """order, ``name``, words, hunks, removed, added, changed: each text against the one before it in its group.

    ``name`` is the ``order`` value (a whole number) of the text before; the first text
    of a group has none and is left out, as are rows without ``order``. ``group`` is
    not null. Texts are dealt once, by stretches of a group.
    """
    part, carried, many, old, new = (free(x, rows) for x in ("_stretch", "_carried", "_many", "_old", "_new"))
    dealt = stretches(rows.where(F.col(order).isNotNull()).select(group, order, text), group, order, part, carried)
    line = Window.partitionBy(group, part).orderBy(order)
    # a text that is alone isn't taken apart
    met = dealt.withColumn(many, F.count("*").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(F.col(many) > 1).select(group, part, carried, order, _lines(F.col(text)).alias(text))
    before = lambda c: F.lag(c).over(line)
    pairs = met.select(order, before(order).alias(name), carried, before(text).alias(old), F.col(text).alias(new))
    return _compared(pairs.where(F.col(name).isNotNull() & ~F.col(carried)).select(order, name, old, new))


def bands(pairs: DataFrame, keys: Sequence[str], old: str, new: str, most_ratio: float, least_letters: int) -> DataFrame:
    """keys, band, changed, words: what to do about a pair of versions.

    'equal' texts are the same to the character; 'nothing' to compare where either
    has fewer letters than ``least_letters``; 'noise' has no changed word; 'review'
    changes at most ``most_ratio`` of the words, 'large' more. Only pairs that are
    neither equal nor too short are taken apart.
    """
    letters = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}]", ""))
    same = F.coalesce(F.col(old) == F.col(new), F.lit(False))
    first = F.when(F.least(letters(old), letters(new)) < least_letters, "nothing").when(same, "equal")
    judged = pairs.select(*keys, old, new, first.alias("band"))
    lines = lambda c: F.when(F.col("band").isNull(), _lines(F.col(c)))
    open_ = _compared(judged.select(*keys, "band", lines(old).alias("old"), lines(new).alias("new")))
    ratio = F.col("changed") / F.col("words")
    own = F.when(F.col("hunks") == 0, "noise").when(ratio <= most_ratio, "review").otherwise("large")
    return open_.select(*keys, F.coalesce("band", own).alias("band"), "changed", "words")
