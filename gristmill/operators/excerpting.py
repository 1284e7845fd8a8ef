"""Excerpts of long texts within a budget, traced to where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import projection

GAP = "\n[...]\n"
SPACE = "[ \t\n\r\f]+"


def places(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, start, end) of every match, and one row (key, null, null) for each text, found or not.

    The parts between matches and the matches tell the places by their lengths
    alone, so no text travels. Matches must not be empty; null texts have no row.
    """
    t = F.col(text)
    parts = F.arrays_zip(F.split(t, pattern, -1).alias("part"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
    sizes = F.transform(parts, lambda p: F.struct(F.length(p["part"]).alias("part"), F.length(p["hit"]).alias("hit")))
    rows = docs.select(key, F.posexplode(sizes).alias("i", "size")).select(key, "i", "size.part", "size.hit")
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("part") + F.coalesce("hit", F.lit(0))).over(w)
    hit = F.col("hit").isNotNull()
    return rows.withColumn("end", end).select(key, F.when(hit, F.col("end") - F.col("hit")).cast("int").alias("start"), F.when(hit, F.col("end")).cast("int").alias("end"))


def articles(docs: DataFrame, key: str, text: str, heading: str, number: str, quoted: str, most: int) -> DataFrame:
    """(key, number, article): the text under each heading whose number a document has once, up to ``most`` characters.

    ``heading`` finds headings, ``number`` (its first group) their numbers, ``quoted`` tells
    those inside a quotation. A quoted article ends at the next heading of any
    kind, another one at the next heading that isn't quoted.
    """
    at = places(docs, key, text, heading).where("start IS NOT NULL")
    told = at.join(docs.select(key, text), key).withColumn("_head", F.substr(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))
    heads = told.select(key, "start", F.length(text).alias("n"), F.lower(F.regexp_extract("_head", number, 1)).alias("number"), F.col("_head").rlike(quoted).alias("quoted"))
    ahead = Window.partitionBy(key).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    any_kind, plain = F.min("start").over(ahead), F.min(F.when(~F.col("quoted"), F.col("start"))).over(ahead)
    stop = F.coalesce(F.when(F.col("quoted"), any_kind).otherwise(plain), "n")
    heads = heads.withColumn("stop", stop).withColumn("times", F.count("*").over(Window.partitionBy(key, "number")))
    held = heads.where((F.col("times") == 1) & (F.col("stop") - F.col("start") <= most)).select(key, "number", "start", "stop")
    part = F.substr(F.col(text), F.col("start") + 1, F.col("stop") - F.col("start"))
    return held.join(docs.select(key, text), key).select(key, "number", F.regexp_replace(part, f"{SPACE}$", "").alias("article"))


RANGE = "struct<a:int,b:int>"


def _range(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def _merged(ranges: Column) -> Column:
    """Ranges in order; those that touch become one."""

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(_range(last["a"], F.greatest(last["b"], x["b"]))))
        return F.when(x["a"] <= last["b"], longer).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(f"array<{RANGE}>"), add)


def budgeted(docs: DataFrame, key: str, text: str, pattern: str, head: int, window: int, most: int, second: str | None = None, fill: bool = False) -> DataFrame:
    """(key, excerpt, segments): the heads of a text and windows around matches, at most ``most`` characters of it.

    The first ``head`` characters always stay, and as many from the first match of
    ``second`` on. Windows come in the order of the text and count what nothing
    before them covers; the first that doesn't fit ends the list. With ``fill``, what is
    left of the budget lengthens the first head. Pieces are trimmed and joined
    by ``GAP``, which the budget doesn't count. ``key`` is unique; null texts have
    no row, empty ones an empty excerpt.
    """
    t, n = F.col(text), F.length(text)
    begin = F.when(t.rlike(second), F.length(F.get(F.split(t, second, 2), F.lit(0)))) if second else F.lit(None).cast("int")
    sizes = docs.select(key, n.alias("n"), F.least(n, F.lit(head)).alias("h1"), begin.alias("h2a"))
    sizes = sizes.withColumn("h2b", F.when(F.col("h2a").isNotNull(), F.least(F.col("h2a") + head, "n")))
    rows = places(docs, key, text, pattern).join(sizes, key)
    found = F.col("start").isNotNull()
    rows = rows.withColumn("a", F.when(found, F.greatest(F.col("start") - window, F.lit(0)))).withColumn("b", F.when(found, F.least(F.col("end") + window, "n")))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_first("a"), "b")
    fresh = F.greatest("a", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), "h1")
    seen = F.greatest(F.least("b", "h2b") - F.greatest("fresh", "h2a"), F.lit(0))
    second_size = F.when(F.col("h2a").isNotNull(), F.greatest(F.col("h2b") - F.greatest("h2a", "h1"), F.lit(0)))
    new = F.greatest(F.col("b") - F.col("fresh"), F.lit(0)) - F.when(F.col("h2a").isNotNull() & (F.col("fresh") < F.col("b")), seen).otherwise(0)
    rows = rows.withColumn("fresh", fresh).withColumn("new", new)
    used = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("h1") + F.coalesce(second_size, F.lit(0))
    rows = rows.withColumn("used", used).where(f"a IS NULL OR used <= {int(most)}")
    # windows that touch are one before they are gathered, so a text's list follows its budget, not its matches
    apart = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(key, "island", "n", "h1", "h2a", "h2b").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = F.collect_list(F.when(F.col("a").isNotNull(), _range(F.col("a"), F.col("b"))))
    heads = F.concat(F.array(_range(F.lit(0), F.col("h1"))), F.when(F.col("h2a").isNotNull(), F.array(_range(F.col("h2a"), F.col("h2b")))).otherwise(F.array().cast(f"array<{RANGE}>")))
    one = islands.groupBy(key, "n", "h1", "h2a", "h2b").agg(spans.alias("spans")).select(key, "n", _merged(F.concat(heads, "spans")).alias("ranges"))
    if fill:
        left = F.lit(most) - F.aggregate("ranges", F.lit(0), lambda s, x: s + x["b"] - x["a"])
        longer = _range(F.lit(0), F.least(F.get("ranges", F.lit(0))["b"] + F.greatest(left, F.lit(0)), "n"))
        one = one.withColumn("ranges", _merged(F.concat(F.array(longer), "ranges")))
    return _cut(docs, one.select(key, "ranges"), key, text)


def _cut(docs: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    def piece(x: Column) -> Column:
        part = F.substring(F.col(text), x["a"] + 1, x["b"] - x["a"])
        bare = F.regexp_replace(part, f"^{SPACE}", "")
        return F.struct(F.regexp_replace(bare, f"{SPACE}$", "").alias("text"), (x["a"] + F.length(part) - F.length(bare)).alias("source"))

    rows = docs.select(key, text).join(ranges, key).withColumn("pieces", F.transform("ranges", piece))
    excerpt, segments = projection.joined(F.col("pieces"), GAP)
    return rows.select(key, excerpt.alias("excerpt"), segments.alias("segments"))
