"""Rows of an old table found again in a new text, whose layout may have moved a row's value.

Both sides are words (letters and digits, lower case), told by Spark. A row is looked
for by its words with its value at each place it can stand: hashes of the new text's
windows of that many words say where, and the words are compared. Rows are taken in
order by a cursor that only moves on: each takes its first place behind the row taken
before it, and a row without one is passed over. A pair's two texts are one row of the
input and are aligned where they lie: nothing is shuffled, and memory follows a pair.

Rows with fewer than ``LEAST_CELLS`` cells or without a number in the last one are
no table rows. Null texts have no rows; a row that is repeated is found as often as
the new text repeats it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.operators.differences import WORD

LEAST_CELLS = 4
NUMBER = r"^\s*[-+]?\d[\d\s.,]*%?\s*$"
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def table_lines(text: Column) -> Column:
    """Structs (line, row, body, value): the table rows of a text; body and value are the words of the value and of the other cells."""
    split = F.transform(F.split(text, r"\r?\n"), lambda row, line: F.struct(line.alias("line"), row.alias("row"), F.split(row, "\t").alias("cells")))
    rows = F.filter(split, lambda x: (F.size(x["cells"]) >= LEAST_CELLS) & F.element_at(x["cells"], -1).rlike(NUMBER))
    words = lambda c: F.array_join(_words(F.lower(c)), " ")
    told = F.transform(rows, lambda x: F.struct(x["line"], x["row"], words(F.array_join(F.slice(x["cells"], F.lit(1), F.size(x["cells"]) - 1), " ")).alias("body"), words(F.element_at(x["cells"], -1)).alias("value")))
    return F.filter(told, lambda x: (x["body"] != "") & (x["value"] != ""))


def _hashes(words: Sequence[str]) -> list[int]:
    """The hash of the first 0, 1, 2... words."""
    out = [0]
    for w in words:
        out.append((out[-1] * _BASE + hash(w)) % _PRIME)
    return out


def taken_rows(rows: Sequence[tuple[Sequence[str], Sequence[str]]], words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
    """(row, first word, last word) of the rows (body, value) that the cursor finds in ``words``."""
    whole, windows, end = _hashes(words), {}, 0
    for n, (body, value) in enumerate(rows):
        size = len(body) + len(value)
        if size not in windows:
            power, places = pow(_BASE, size, _PRIME), {}
            for at in range(len(words) - size + 1):
                places.setdefault((whole[at + size] - whole[at] * power) % _PRIME, []).append(at)
            windows[size] = places
        places, own, inner = windows[size], _hashes(body), _hashes(value)[-1]
        shift, best = pow(_BASE, len(value), _PRIME), None
        tail = 1
        # the value behind all words, then before the last one, and so on
        for o in range(len(body), -1, -1):
            form = ((own[o] * shift + inner) * tail + own[-1] - own[o] * tail) % _PRIME
            tail = tail * _BASE % _PRIME
            here = places.get(form, ())
            for k in range(bisect_left(here, end), len(here)):
                at = here[k]
                if best is not None and at >= best:
                    break
                if [*body[:o], *value, *body[o:]] == words[at : at + size]:
                    best = at
                    break
        if best is not None:
            end = best + size
            yield n, best, end - 1


def aligned(pairs: DataFrame, keys: Sequence[str], old: str, new: str) -> DataFrame:
    """keys, line, row, start, end, found: the old table's rows that the new text holds, in order, and the characters they take there."""
    told = pairs.select(*keys, table_lines(F.col(old)).alias("rows"), F.col(new).alias("text"), _words(F.col(new)).alias("words"))
    # the words as they stand, to find their characters, and in lower case
    told = told.select(*keys, "rows", "text", F.array_join("words", " ").alias("words"), F.array_join(F.transform("words", F.lower), " ").alias("low"))
    schema = StructType(told.schema.fields[: len(keys)]).add("line", "long").add("row", "string").add("start", "long").add("end", "long").add("found", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for i, (rows, text, written, low) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True)):
                if not rows or not low:
                    continue
                spans, end = [], 0
                for w in written.split():
                    start = text.index(w, end)
                    end = start + len(w)
                    spans.append((start, end))
                for n, first, last in taken_rows([(x["body"].split(" "), x["value"].split(" ")) for x in rows], low.split(" ")):
                    start, end = spans[first][0], spans[last][1]
                    owners.append(i)
                    out.append((rows[n]["line"], rows[n]["row"], start, end, text[start:end]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            own = [c.take(pa.array(owners, pa.int64())) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return told.mapInArrow(run, schema)
