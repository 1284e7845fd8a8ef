"""Edge cases of sittings, letters, bundles, reach and records."""

import datetime as dt

from pyspark.sql import functions as F

from gristmill.change_queries import _MONTHS
from gristmill.functions import dates, json, letters, text, wording
from gristmill.operators import decisions, folds, keyed, records, selection, sittings, stages


def test_sittings_meet_by_numbers_and_once(spark):
    bills = spark.createDataFrame([(1, ["10", "11", "10"]), (2, None), (3, [])], "own int, numbers array<string>")
    listed = spark.createDataFrame([("b", "mon", ["10"]), ("a", "mon", ["11", "10"]), ("c", "tue", ["11"]), ("d", "wed", None), ("e", None, ["10"])], "ref string, day string, named array<string>")
    told = spark.createDataFrame([(1, "b"), (9, "a")], "own int, ref string")
    got = sorted((r.own, r.ref, r.day, r.shared) for r in sittings.matched(bills, "own", "numbers", listed, "ref", "named", ["day"], told).collect())
    assert got == [(1, "b", "mon", ["10"]), (1, "c", "tue", ["11"]), (1, "e", None, ["10"])]


def test_the_same_sitting_under_another_ref(spark):
    items = spark.createDataFrame([(1, "x9"), (1, "x7"), (2, "y")], "k int, ref string")
    told = spark.createDataFrame([(1, "x7", 1), (1, "x8", 2), (2, "y", 1)], "k int, ref string, day int")
    assert {(r.k, r.ref): r.moved_from for r in sittings.moved(items, told, ["k"], "ref", "day").collect()} == {(1, "x9"): "x8", (1, "x7"): "x8", (2, "y"): None}


def test_conditions_cover_by_numeral_or_place(spark):
    rows = [(["II. print 7", "print 8"], ["7"], [2]), (["II. print 7", "print 8"], ["8"], [1]), (["II. print 7", "print 8"], ["8"], [2]), (["print 7"], ["9"], []), (["print 7", "print 7"], ["7"], [2]), ([], ["7"], [1])]
    d = spark.createDataFrame(rows, "items array<string>, numbers array<string>, points array<int>")
    got = [r.c for r in d.select(sittings.covers(F.col("items"), F.col("numbers"), F.col("points"), r"print (\d+)", r"^([IVXLC]+)\.").alias("c")).collect()]
    assert got == [True, False, True, True, True, False]


def test_days_and_deadlines_of_letters(spark):
    days = ["3 May 2024", "on 03.05.2024", "31 june 2024", "5 Floreal 2024", "nothing", None, "29.02.2023", "1 MARCH 2024"]
    got = [r.d for r in spark.createDataFrame([(x,) for x in days], "t string").select(letters.day(F.col("t"), _MONTHS).alias("d")).collect()]
    assert got == [dt.date(2024, 5, 3), dt.date(2024, 5, 3), None, None, None, None, None, dt.date(2024, 3, 1)]
    d = dt.date
    rows = [((d(2024, 1, 1), 5, d(2024, 2, 1)), d(2024, 2, 2)), ((d(2024, 1, 1), 5, d(2030, 1, 1)), d(2024, 1, 1)), ((None, 7, None), d(2024, 3, 1)), ((None, None, d(2023, 1, 1)), d(2024, 1, 1)), ((None, None, None), d(2024, 1, 1))]
    t = spark.createDataFrame(rows, "told struct<written:date,days:int,until:date>, published date")
    assert [r.x for r in t.select(letters.deadline(F.col("told"), F.col("published"), 60).alias("x")).collect()] == [d(2024, 2, 1), d(2024, 1, 6), d(2024, 3, 8), None, None]
    texts = spark.createDataFrame([("Ref  AB – 1\n–22 x",), ("none",), (None,)], "t string")
    assert [r.n for r in texts.select(letters.sender_number(F.col("t"), r"AB\s*[-–]\s*\d+\s*[-–]\s*\d+", 100).alias("n")).collect()] == ["AB-1-22", None, None]


def test_bundles_choose_or_say_why_not(spark):
    rows = [
        (1, 1, "bill", 1, "x", False), (1, 2, "bill", 0, "y", False), (1, 3, "annex", 0, "z", False), (1, 4, "", 0, "z", True),
        (2, 1, "bill", 0, "x", False), (2, 2, "bill", 0, "x", True), (3, 1, "bill", 0, "x", False), (3, 2, "bill", 0, None, False),
        (4, 1, "annex", 0, "x", False), (5, 1, "bill", 0, None, True), (6, 2, "bill", 0, "x", False), (6, 9, "annex", 0, "q", True), (6, 1, "annex", 0, "q", None),
    ]
    d = spark.createDataFrame(rows, "b int, part int, kind string, best int, digest string, lost boolean")
    roles = [(F.col("kind") == "annex", "annex"), (F.col("kind") == "bill", "bill")]
    got = {r.b: (r.state, r.chosen, r.annexes, r.rejected) for r in selection.selected(d, ["b"], "part", roles, "bill", "annex", [F.col("best")], F.col("digest"), F.col("lost")).collect()}
    assert got == {1: ("chosen", 2, [3], 2), 2: ("chosen", 1, [], 1), 3: ("conflict", None, [], 2), 4: ("none", None, [], 1), 5: ("waiting", 1, [], 0), 6: ("waiting", 2, [1, 9], 0)}


def test_what_is_needed_over_cycles(spark):
    uses = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (6, 6), (7, None)], "a int, b int")
    start = spark.createDataFrame([(2,), (6,), (None,)], "k int")
    assert sorted(r.k for r in selection.needed(uses, "a", "b", start, "k").collect()) == [1, 2, 3, 6]
    p = spark.createDataFrame([(k, k in (1, 2, 3, 5, 8)) for k in range(1, 9)] + [(9, None)], "k int, old boolean")
    assert sorted(r.k for r in selection.prunable(p, "k", F.col("old"), uses, "a", "b").collect()) == [1, 2, 3, 8]


def test_texts_that_are_scraps(spark):
    d = spark.createDataFrame([("x" * 50, 0), ("x" * 50, 10), ("x" * 5, 0), (None, 1), ("x" * 50, None)], "t string, pages int")
    assert [r.c for r in d.select(selection.carries_text(F.col("t"), F.col("pages"), 10, 6.0).alias("c")).collect()] == [True, False, False, False, True]


def test_records_of_other_shapes(spark):
    d = spark.createDataFrame([(1, '{"votes":[{"MP":1,"vote":"YES"},{"club":"A","vote":null}]}'), (2, "{"), (3, None), (4, '{"votes":[]}')], "k int, t string")
    assert sorted(tuple(r) for r in records.club_votes(d, ["k"], "t").collect()) == [(1, "", 1, 0, 0, 0, None), (1, "A", 0, 0, 0, 1, None)]
    rows = records.listed(spark.createDataFrame([('[{"a":"5","b":"2024-01-02"},{"a":[1],"b":"x"},3]',), ("no",), (None,)], "t string"), "t", {"a": ("a", "int"), "b": ("b", "date")})
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(5, dt.date(2024, 1, 2)), (None, None), (None, None)], key=str)


def test_news_and_keys(spark):
    d = spark.createDataFrame([(1, True, None, None, None), (2, None, None, True, True), (3, None, None, True, None), (3, None, None, None, False), (4, None, True, None, None), (5, None, None, None, None)], "k int, a boolean, b boolean, c boolean, d boolean")
    assert {r.k: r.news for r in decisions.news(d, ["k"], *map(F.col, "abcd")).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    k = spark.createDataFrame([("s", True, ["b", "a"]), ("s", True, ["a", "b", "a"]), ("s", False, ["a", "b"]), ("s", None, []), ("s", None, None)], "s string, c boolean, f array<string>").select(wording.change_key([F.col("s")], F.col("c"), F.col("f")).alias("k"))
    keys = [r.k for r in k.collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] and len(set(keys)) == 3


def test_phases_over_very_many_stages(spark):
    n = 100_001
    d = spark.range(n).select(F.lit(1).alias("_order"), F.col("id").alias("at"), F.when(F.col("id") % 2 == 0, "go").otherwise("back").alias("_stage"))
    d = d.union(spark.createDataFrame([(2, 0, None), (None, 1, "go")], "_order int, at long, _stage string"))
    got = {r._order: (r.phase, r.moved) for r in stages.phases(d, ["_order"], "at", "_stage", {("a", "go"): "b", ("b", "back"): "a"}, "a").collect()}
    assert got == {1: ("b", n), 2: ("a", 0), None: ("b", 1)}


def test_ends_of_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = spark.createDataFrame([(k, i) for k in range(20) for i in range(k % 5 + 1)], "k int, x int").repartition("k").sortWithinPartitions("k", "x")
        got = folds.ended(d, 1, lambda: 0, lambda s, x: s + x, lambda s: s, "total", "int").collect()
        assert {r.k: r.total for r in got} == {k: sum(range(k % 5 + 1)) for k in range(20)} and len(got) == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_helper_names_clash_with_nothing(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 3)], "k int, _rank string, _new int")
    assert sorted(map(tuple, keyed.first_per_key(d, ["k"], [F.desc("_new")]).collect())) == [(1, "y", 2), (2, "z", 3)]
    new = spark.createDataFrame([(2, "n", 9)], "k int, _rank string, _new int")
    assert sorted(map(tuple, keyed.upsert(d.where("_new > 1"), new, ["k"]).collect())) == [(1, "y", 2), (2, "n", 9)]
    assert keyed.looked_up(d.withColumn("n", F.lit(None).cast("int")), {"k": 1, "n": None}).count() == 2


def test_members_leave_a_json_text(spark):
    texts = ['{"b":{"c":1,"d":{"c":2}},"a":"x"}', '{"b":[1]}', "[1,2]", "{", None, '{"b":null,"a":1.5}']
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in d.select(json.without_paths(F.col("t"), "a", "b.c", "b.d.c").alias("x")).collect()]
    assert got == ['{"b":{"d":{}}}', '{"b":[1]}', "[1,2]", None, None, '{"b":null}']


def test_bounds_of_weeks(spark):
    labels = ["2020-W53", "2021-W53", "2024-W01", "2024-W00", "x", None, "2026-W99"]
    got = [r.w for r in spark.createDataFrame([(x,) for x in labels], "t string").select(dates.week_bounds(F.col("t")).alias("w")).collect()]
    assert [(w.start, w.end) if w else None for w in got] == [(dt.date(2020, 12, 28), dt.date(2021, 1, 3)), None, (dt.date(2024, 1, 1), dt.date(2024, 1, 7)), None, None, None, None]


def test_clips_keep_what_they_were_shown_for(spark):
    long = "one two three four five six seven eight nine ten print 12 end print 7 of all"
    rows = [(long, ["12"]), (long, ["7"]), (long, ["99"]), (long, []), ("print 7 first " + long, ["7"]), ("short", ["7"]), (None, ["7"])]
    d = spark.createDataFrame(rows, "t string, k array<string>")
    got = [r.c for r in d.select(text.clipped_keeping(F.col("t"), 40, "print ", F.col("k")).alias("c")).collect()]
    assert got[0].endswith("... print 12 end print 7") and got[1].endswith("... print 7 of all") and all(c is None or len(c) <= 43 for c in got)
    assert got[2] == got[3] and got[4].startswith("print 7 first") and got[4].endswith("...") and got[5:] == ["short", None]


def test_folded_lists_with_nulls(spark):
    d = spark.createDataFrame([("Abc", None), (None, ["x", None, "zAB"]), (None, None), ("x", [])], "t string, l array<string>")
    assert [r.h for r in d.select(text.any_contains_folded(F.col("t"), F.col("l"), "aB").alias("h")).collect()] == [True, True, False, False]
