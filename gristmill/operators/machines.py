"""State machines over long sequences, by composing maps.

A row is a map from each state to the next one, an array of state numbers. Maps
compose, and in any grouping, so a sequence is folded in chunks of ``CHUNK`` rows,
the chunks in chunks, up to one map; then each chunk is told the state it begins
in, and passes it on to what it is made of. So a sequence of any length is
dealt to many tasks, and a row never holds more than ``CHUNK`` maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.graphs import kept

CHUNK = 256
Moves = Sequence[int]


def moves_of(kind: Column, moves: dict[str, Moves], states: int) -> Column:
    """The map of a kind; an unknown or null kind stays where it is."""
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in moves]), F.array(*[F.array(*[F.lit(int(s)) for s in m]) for m in moves.values()]))
    return F.coalesce(F.try_element_at(table, kind), F.array(*[F.lit(s) for s in range(states)]))


def then(first: Column, second: Column) -> Column:
    """The map that goes through ``first`` and then ``second``."""
    return F.transform(first, lambda s: F.get(second, s))


def states(rows: DataFrame, key: Sequence[str], order: str, move: Column, start: int, count: int) -> DataFrame:
    """(owner, place, before, after): the state of each row of a key before and after it.

    ``owner`` is a struct of the keys; ``order`` counts from 0 without gaps; ``move`` is the row's map.
    """
    level = kept(rows.select(F.struct(*key).alias("owner"), F.col(order).cast("long").alias("place"), move.alias("move")))
    grouped = []
    same = F.array(*[F.lit(s) for s in range(count)])
    while True:
        listed = F.array_sort(F.collect_list(F.struct("place", "move")))
        chunks = kept(level.groupBy("owner", F.floor(F.col("place") / CHUNK).cast("long").alias("chunk")).agg(F.transform(listed, lambda x: x["move"]).alias("moves")))
        grouped.append(chunks)
        if chunks.where("chunk > 0").isEmpty():
            break
        level = chunks.select("owner", F.col("chunk").alias("place"), F.aggregate("moves", same, then).alias("move"))
    begin = grouped[-1].select("owner", "chunk", F.lit(start).alias("state"))
    for chunks in reversed(grouped):
        held = chunks.join(begin, ["owner", "chunk"])
        # after[i] is the state behind the i-th row of the chunk
        after = F.aggregate("moves", F.array("state"), lambda done, m: F.concat(done, F.array(F.get(m, F.element_at(done, -1)))))
        told = held.select("owner", "chunk", F.posexplode(F.arrays_zip(F.slice(after, F.lit(1), F.size("moves")).alias("before"), F.slice(after, F.lit(2), F.size("moves")).alias("after"))).alias("i", "x"))
        told = told.select("owner", (F.col("chunk") * CHUNK + F.col("i")).alias("place"), "x.before", "x.after")
        begin = told.select("owner", F.col("place").alias("chunk"), F.col("before").alias("state"))
    return told


def trimmed(pages: DataFrame, key: Sequence[str], page: str, body: str, kind: Column, moves: dict[str, Moves], names: Sequence[str], dropped: Sequence[str], cuts: dict[str, tuple[str, str]], gap: str, start: int = 0) -> DataFrame:
    """keys, text, segments, left_out: the kept sections of a document, with a mark for each dropped run.

    ``names`` names the states. A page lies in the state that its kind leads to. In a
    state of ``cuts`` (pattern, next state) a page is kept up to the pattern's first
    match, and the next state begins within it. ``dropped`` states are left out;
    pages of one such run become one mark that tells its name and characters.
    ``segments`` (at, length, source) trace the text to the pages joined by ``gap``.
    ``page`` counts from 0 without gaps; null bodies are empty.
    """
    number = {n: i for i, n in enumerate(names)}
    own = pages.select(F.struct(*key).alias("owner"), F.col(page).cast("long").alias("place"), F.coalesce(F.col(body), F.lit("")).alias("body"), kind.alias("kind"))
    move, cut_at = moves_of(F.col("kind"), moves, len(names)), []
    for state, (pattern, following) in cuts.items():
        found = F.col("body").rlike(pattern)
        into = F.array(*[F.lit(number[following] if s == number[state] else s) for s in range(len(names))])
        cut_at.append((number[state], F.when(found, F.regexp_instr("body", F.lit(pattern)) - 1)))
        move = F.when(found, then(move, into)).otherwise(move)
    known = own.select("owner.*", "place", move.alias("move"))
    at = states(known, key, "place", F.col("move"), start, len(names))
    plain = moves_of(F.col("kind"), moves, len(names))
    rows = own.join(at, ["owner", "place"]).withColumn("here", F.get(plain, F.col("before")))
    cut = F.coalesce(*[F.when(F.col("here") == s, c) for s, c in cut_at], F.lit(None)) if cut_at else F.lit(None)
    out = F.col("here").isin(*[number[n] for n in dropped])
    size = F.length("body")
    rows = rows.select("owner", "place", "body", "here", "after", cut.cast("int").alias("cut"), out.alias("out"))
    label = F.array(*[F.lit(n) for n in names])
    parts = F.array_compact(F.array(
        F.when(~F.col("out"), F.struct(F.lit(0).alias("half"), F.lit(None).cast("string").alias("name"), F.coalesce(F.rtrim(F.substr("body", F.lit(1), F.col("cut"))), F.col("body")).alias("text"), F.lit(0).alias("chars"))),
        F.when(F.col("out"), F.struct(F.lit(0).alias("half"), F.get(label, F.col("here")).alias("name"), F.lit("").alias("text"), size.alias("chars"))),
        F.when(~F.col("out") & F.col("cut").isNotNull(), F.struct(F.lit(1).alias("half"), F.get(label, F.col("after")).alias("name"), F.lit("").alias("text"), (size - F.col("cut")).alias("chars"))),
    ))
    through = Window.partitionBy("owner").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("source", F.coalesce(F.sum(size + len(gap)).over(through), F.lit(0)))
    pieces = placed.select("owner", "place", "source", F.explode(parts).alias("p")).select("owner", "place", "source", "p.*")
    line = Window.partitionBy("owner").orderBy("place", "half")
    new = F.when(F.col("name").isNotNull() & F.col("name").eqNullSafe(F.lag("name").over(line)), 0).otherwise(1)
    runs = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(line))
    merged = runs.groupBy("owner", "run").agg(F.max("name").alias("name"), F.first("text").alias("text"), F.sum("chars").alias("chars"), F.min("source").alias("source"))
    mark = F.concat(F.lit("\n[left out: "), F.col("name"), F.lit(", "), F.col("chars").cast("string"), F.lit(" characters]\n"))
    merged = merged.select("owner", "run", F.when(F.col("name").isNull(), F.col("text")).otherwise(mark).alias("text"), F.when(F.col("name").isNull(), F.col("source")).alias("source"), F.when(F.col("name").isNotNull(), F.col("chars")).alias("chars"))
    up = Window.partitionBy("owner").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("at", F.coalesce(F.sum(F.length("text") + len(gap)).over(up), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("run", "text", "at", "source")))
    whole = merged.groupBy("owner").agg(listed.alias("pieces"), F.coalesce(F.sum("chars"), F.lit(0)).alias("left_out"))
    segment = F.transform(F.filter("pieces", lambda p: p["source"].isNotNull() & (F.length(p["text"]) > 0)), lambda p: F.struct(p["at"].cast("int").alias("at"), F.length(p["text"]).alias("length"), p["source"].cast("int").alias("source")))
    return whole.select("owner.*", F.array_join(F.transform("pieces", lambda p: p["text"]), gap).alias("text"), segment.alias("segments"), F.col("left_out").cast("long").alias("left_out"))
