"""Budgeted excerpts and traced positions against plain Python, character by character."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import projection
from gristmill.operators import excerpting, pages, ranking

GAP = excerpting.GAP


def texts(seed=4, n=120):
    r = random.Random(seed)
    return ["", None, "key", "  ", "JUST"] + ["".join(r.choice(["a ", " b", "key", "K\n", "  \n", "JUST", "é𝒳"]) for _ in range(r.randint(0, 120))) for _ in range(n)]


def plain(text, pattern, head, window, most, second, fill):
    """The ranges as a set of characters."""
    n, heads = len(text), [(0, min(head, len(text)))]
    if second and (m := re.search(second, text)):
        heads.append((m.start(), min(m.start() + head, n)))
    ranges, covered = list(heads), {i for a, b in heads for i in range(a, b)}
    for m in re.finditer(pattern, text):
        a, b = max(0, m.start() - window), min(n, m.end() + window)
        if len(covered | set(range(a, b))) > most:
            break
        covered |= set(range(a, b))
        ranges.append((a, b))

    def merged(ranges):
        out = []
        for a, b in sorted(map(tuple, ranges)):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return out

    out = merged(ranges)
    if fill:
        out = merged([*out, (0, min(n, out[0][1] + max(0, most - len(covered))))])
    space = " \t\n\r\f"
    return [(text[a:b].strip(space), a + len(text[a:b]) - len(text[a:b].lstrip(space))) for a, b in out]


@pytest.mark.parametrize(("second", "fill"), [("JUST", True), ("JUST", False), (None, True)])
def test_excerpts_equal_plain_python(spark, second, fill):
    every = list(enumerate(texts()))
    d = spark.createDataFrame(every, "k long, t string")
    got = {r.k: r for r in excerpting.budgeted(d, "k", "t", "key|K", 20, 6, 80, second, fill).collect()}
    assert set(got) == {k for k, t in every if t is not None}
    for k, t in every:
        if t is not None:
            pieces = plain(t, "key|K", 20, 6, 80, second, fill)
            assert got[k].excerpt == GAP.join(p for p, _ in pieces), (k, t)
            want = [i for n, (p, a) in enumerate(pieces) for i in [None] * (len(GAP) if n else 0) + [*range(a, a + len(p))]]
            assert traced(got[k].segments) == want
    assert excerpting.budgeted(d.limit(0), "k", "t", "key", 20, 6, 80).count() == 0


def traced(segments):
    """Source of every position, and that segments follow each other without a gap."""
    out = []
    for s in segments:
        assert s["at"] == len(out)
        out += [None if s["source"] is None else s["source"] + i for i in range(s["length"])]
    return out


def test_cuts_of_cuts_are_traced_to_the_source(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts(9)) if t], "k long, t string")
    first = excerpting.budgeted(d, "k", "t", "key|K", 20, 6, 80, "JUST")
    again = excerpting.budgeted(first.select("k", "excerpt"), "k", "excerpt", "b", 5, 2, 30).withColumnRenamed("segments", "later")
    both = again.select("k", "later").join(first.select("k", "segments"), "k")
    at = F.explode(F.sequence(F.lit(0), F.lit(40)))
    rows = both.select("*", projection.composed(F.col("later"), F.col("segments")).alias("all"), projection.sliced(F.col("later"), F.lit(3), F.lit(17)).alias("part")).collect()
    for r in rows:
        inner, outer = traced(r.segments), traced(r.later)
        assert traced(r["all"]) == [None if i is None else inner[i] for i in outer]
        assert traced(r.part) == outer[3:17]
    for r in both.select("later", at.alias("at")).select("later", "at", projection.source_of(F.col("later"), F.col("at")).alias("source")).collect():
        held = traced(r.later)
        assert r.source == (held[r.at] if r.at < len(held) else None)


def test_parts_are_cut_at_the_last_space_that_fits(spark):
    def slow(t, limit):
        out, i = [], 0
        while True:
            size, j = 0, i
            while j < len(t) and size + 1 + (ord(t[j]) > 0xFFFF) <= limit:
                size, j = size + 1 + (ord(t[j]) > 0xFFFF), j + 1
            if j == len(t):
                return [*out, t[i:]]
            cut = t.rfind(" ", i, j) + 1 or j
            out.append(t[i:cut])
            i = cut

    r = random.Random(2)
    every = ["", "x" * 95, "𝒳" * 30] + ["".join(r.choice(["a", "bc ", "𝒳", " ", "word" * 4]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(every)), "k long, t string")
    got = {}
    for x in sorted(pages.message_parts(d, "k", "t", 10).collect()):
        got.setdefault(x.k, []).append(x.body)
    assert got == {k: slow(t, 10) for k, t in enumerate(every)}


def test_the_row_before_in_a_group_whatever_the_stretch(spark):
    r = random.Random(3)
    every = [(r.choice(["a", "b", None]), i) for i in r.sample(range(400), 120)]
    d = spark.createDataFrame(every, "g string, i long")
    last, want = {}, {}
    for g, i in sorted(every, key=lambda x: x[1]):
        want[i], last[g] = last.get(g), i
    for stretch in (1, 7, 64, 1000):
        assert {x.i: x.old for x in ranking.with_previous(d, F.col("g"), "i", "old", stretch).collect()} == want
