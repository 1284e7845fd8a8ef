"""Ladders of rules and state between runs: nulls, ties, empty tables."""

import datetime as dt
import re

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import decisions, incremental, pages


def test_decisions_follow_the_last_stage(spark):
    rows = [
        ("veto", 1, "passed", None, True), ("veto", 2, "vetoed", None, True), ("again", 1, "vetoed", None, None), ("again", 2, "overridden", None, None),
        ("denied", 1, "passed", False, True), ("flag", 1, None, True, None), ("closed", 1, None, None, True), ("open", 1, None, None, None), ("refused", 1, None, False, True),
        ("early", 1, None, False, False),
    ]
    s = spark.createDataFrame(rows, "k string, i int, o string, passed boolean, closed boolean")
    o = F.col("o")
    veto, ended = F.when(o.isin("vetoed", "overridden"), o), F.when(o == "passed", o)
    got = decisions.decided(s, ["k"], "i", veto, F.lit(None).cast("string"), ended, "passed", "closed")
    want = {"veto": "vetoed", "again": "overridden", "denied": "unknown", "flag": "passed", "closed": "unknown", "open": "absent", "refused": "refused", "early": "absent"}
    assert {r.k: r.decision for r in got.collect()} == want
    assert decisions.decided(s.limit(0), ["k"], "i", veto, veto, ended, "passed", "closed").count() == 0


def test_only_weighty_stages_before_a_known_one_are_late(spark):
    s = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, False)], "k string, i int, known boolean")
    got = decisions.told_late(s, ["k"], "i", F.col("known"), F.lit(True))
    assert {r.k: r.late for r in got.collect()} == {"a": True, "b": False, "c": False}


def test_attention_without_a_rule_is_uncertain(spark):
    today = dt.date(2026, 5, 1)
    d = spark.createDataFrame([("x", today), (None, None), ("y", today + dt.timedelta(4))], "t string, due date")
    got = decisions.assessed(d, [(F.col("t") == "x", "important", "new")], F.col("due"), F.lit(today)).collect()
    assert [(r.importance, r.urgency, r.reasons) for r in got] == [("important", "urgent", ["new", "near_deadline"]), ("uncertain", "normal", ["unclassified"]), ("uncertain", "normal", ["unclassified"])]


def test_watermark_looks_back_without_a_success(spark):
    r = spark.createDataFrame([(1, dt.datetime(2026, 1, 5), False), (2, dt.datetime(2026, 1, 3), True)], "id int, t timestamp_ntz, ok boolean")
    now = F.lit("2026-01-10").cast("timestamp_ntz")
    assert incremental.low_watermark(r, "t", F.col("ok"), 1, now, 7).first().since == dt.datetime(2026, 1, 2)
    assert incremental.low_watermark(r.limit(0), "t", F.col("ok"), 1, now, 7).first().since == dt.datetime(2026, 1, 3)
    assert [x.id for x in incremental.retained(r, "id", "t", F.col("ok"), F.lit("2026-01-04").cast("timestamp_ntz")).collect()] == [1, 2]
    assert incremental.retained(r, "id", "t", F.lit(False), now).count() == 0


def test_outbox(spark):
    o = spark.createDataFrame([("pending", None, 1), ("failed", "e", None), ("failed", "e", 3), (None, None, 0)], "status string, error string, n int")
    assert [(r.status, r.error) for r in incremental.swept(o, "status", "error", "left").collect()] == [("unknown", "left"), ("failed", "e"), ("failed", "e"), (None, None)]
    assert incremental.due_again(o, "status", "n", 3).count() == 1


def test_ranges(spark):
    kind = "array<struct<start:bigint,end:bigint>>"
    rows = [([(5, 9), (1, 3), (3, 5)], [(1, 9)]), ([(1, 3), (5, 9)], [(2, 6)]), ([(1, 3)], []), (None, [(1, 2)]), ([(1, 3)], None)]
    d = spark.createDataFrame(rows, f"a {kind}, r {kind}")
    assert [r.c for r in d.select(incremental.ranges_cover(F.col("a"), F.col("r")).alias("c")).collect()] == [True, False, False, False, False]


def test_worded_dates_and_page_bodies(spark):
    months = ["May", "June"] + [f"m{i}" for i in range(10)]
    d = spark.createDataFrame([("on 3 MAY 2026",), ("31 June 2026",), ("none",), (None,)], "t string")
    assert [r.x for r in d.select(text.worded_date(F.col("t"), months).alias("x")).collect()] == [dt.date(2026, 1, 3), None, None, None]
    p = spark.createDataFrame([("\n - 12 -\n\nTitle\n3\n",), ("12 men\n",)], "t string")
    assert [r.x for r in p.select(text.page_body(F.col("t")).alias("x")).collect()] == ["Title\n3\n", "12 men\n"]


def test_markup_parts_stand_alone():
    html = "<b>one <i>two words</i> three</b> " + "x" * 70 + " &amp; <a href='u'>link 𝄞 text</a> end"
    parts = list(pages._markup_parts(html, 60))
    assert "".join(re.sub("<[^>]*>", "", p) for p in parts) == re.sub("<[^>]*>", "", html)
    for p in parts:
        assert len(p.encode("utf-16-le")) // 2 <= 60
        opened = []
        for close, name in re.findall(r"<(/?)(\w+)", p):
            assert not close or opened.pop() == name
            if not close:
                opened.append(name)
        assert not opened
    assert list(pages._markup_parts("", 60)) == []
