"""Listing pages as rows: the cells of tables or lists.

The JVM cuts a page at its tags; comments, scripts and styles are cut out whole. The
page is then walked once where it lies, without a shuffle or a sort: a stack holds
the containers that are open, so nested ones are told apart, and what follows the
last opening of a container belongs to it until it is closed. Rows and cells need no
closing tags: a cell ends where the next cell or row begins or where its row or
container ends, a container that is never closed ends with its page. A closing tag
without an opening one closes nothing. Null pages have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import decoded

TAG = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>"
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
#: Cells, and characters in them, that leave in one batch.
TOGETHER, CHARACTERS = 20_000, 4_000_000


def plain(text: Column) -> Column:
    """``text`` without entities, white space as one space; an unknown name stays as it is."""
    return F.trim(F.regexp_replace(F.replace(decoded(text), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def _walked(tags: Sequence[str], texts: Sequence[str], container: str, row: str, cell: Sequence[str]) -> Iterator[tuple]:
    """container, parent, row, cell, start, texts, links of a page's cells; ``texts`` is what stands before the first tag and behind each one."""
    # of an open container: its number, its parent, row, whether in it, cell, and that cell if it is open
    stack: list[list] = []
    found: list[tuple] = []
    start = len(texts[0])
    for n, (tag, text) in enumerate(zip(tags, texts[1:], strict=True), 1):
        match = _NAME.match(tag)
        name, opens = match[1].lower() if match else "", not tag.startswith("</")
        if name == container:
            if opens:
                stack.append([n, stack[-1][0] if stack else None, 0, False, 0, None])
            elif stack:
                stack.pop()
        if stack:
            top = stack[-1]
            if name == row:
                if opens:
                    top[2], top[4] = top[2] + 1, 0
                top[3], top[5] = opens, None
            if name in cell:
                top[4] += opens
                if name != row:
                    top[5] = None
                    if opens and top[3]:
                        top[5] = (top[0], top[1], top[2], top[4], start, [], [])
                        found.append(top[5])
            if top[5]:
                top[5][5].append(text)
                if name == "a" and opens:
                    top[5][6].append(tag)
        start += len(tag) + len(text)
    return iter(found)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; null without one."""
    found = lambda g: F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))", g)
    return F.nullif(F.concat(found(1), found(2), found(3)), F.lit(""))


def cells(pages: DataFrame, keys: Sequence[str], html: str, container: str = "table", row: str = "tr", cell: Sequence[str] = ("td", "th")) -> DataFrame:
    """keys, container, parent, row, cell, start, text, href: the cells of all containers of a page.

    Containers are numbered by the place of their tag, rows and cells from 1;
    ``parent`` is the container that one lies in (null: none). ``href`` is the first link of a
    cell. What a nested container holds is told with that one, not with the cell
    around it. Cells outside a row are left out.
    """
    text, cell = F.col(html), tuple(cell)
    names = ["at", "container", "parent", "row", "cell", "start", "text", "links"]
    rows = pages.where(text.isNotNull()).select(F.struct(*keys).alias("owner"), F.regexp_extract_all(text, F.lit(TAG), F.lit(0)).alias("tags"), F.split(text, TAG, -1).alias("texts"))
    schema = f"owner {rows.schema['owner'].dataType.simpleString()}, container int, parent int, row long, cell long, start long, text string, links array<string>"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]

    def sent(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["owner", *names[1:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                # by way of numpy: to_pylist takes ten times as long for short texts
                tags, texts = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2))
                for *place, said, links in _walked(tags, texts, container, row, cell):
                    told = " ".join(said)
                    held.append((i, *place, told, links))
                    size += len(told) + sum(map(len, links))
                    if len(held) >= TOGETHER or size >= CHARACTERS:
                        yield sent(batch, held)
                        held, size = [], 0
            if held:
                yield sent(batch, held)

    found = rows.mapInArrow(run, schema)
    href = F.get(F.filter(F.transform("links", lambda x: attribute(x, "href")), lambda x: x.isNotNull()), F.lit(0))
    return found.select("owner.*", "container", "parent", "row", "cell", "start", plain(F.col("text")).alias("text"), href.alias("href"))
