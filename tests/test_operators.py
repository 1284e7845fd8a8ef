"""Edge cases: nulls, ties, empty tables, order, time zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates, text
from gristmill.operators import differences, figures, folds, graphs, joins, keyed, pages, trees
from gristmill.sources.tables import mapped_headers, read_json_pages, read_register


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_keywords_need_a_strong_hit(spark):
    rows = [("a", "Beta beta beta"), ("b", "weak weak weak"), ("c", "ALPHA and beta"), ("d", None), ("e", "żółw ŻÓŁW Żółwie")]
    p = {"alpha": r"\balpha\b", "beta": r"\bbeta\b", "weak": "weak", "turtle": r"\bżółw\w*"}
    d = spark.createDataFrame(rows, "k string, t string").withColumn("m", text.keyword_counts(F.col("t"), p))
    assert values(d.withColumn("ok", text.enough_hits(F.col("m"), ["weak"])), "k", "ok") == [("a", True), ("b", False), ("c", True), ("d", False), ("e", True)]


def test_digest_ignores_spacing(spark):
    d = spark.createDataFrame([(" a  b\n",), ("a b",), (None,)], "t string").select(text.digest(F.col("t")).alias("x"))
    a, b, c = [r.x for r in d.collect()]
    assert a == b and c is None


def test_upsert_keeps_values_that_new_rows_lack(spark):
    old = spark.createDataFrame([(1, "x", "first"), (2, None, "first")], "k int, v string, seen string")
    new = spark.createDataFrame([(1, None, "later"), (2, "y", "later"), (3, None, "later")], "k int, v string, seen string")
    assert values(keyed.upsert(old, new, ["k"], ["v"], ["seen"]), "k", "v", "seen") == [(1, "x", "first"), (2, "y", "first"), (3, None, "later")]
    assert keyed.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_first_per_key_breaks_ties_by_position(spark):
    d = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", None, 2), ("b", 0, 3)], "k string, t int, pos int")
    assert values(keyed.first_per_key(d, ["k"], [F.desc("t"), F.asc("pos")]), "k", "pos") == [("a", 0), ("b", 3)]


def test_longest_prefix_and_unknown_price(spark):
    d = spark.createDataFrame([("m-1-x",), ("m-2",), ("z",)], "name string")
    t = spark.createDataFrame([("m", 1.0), ("m-1", 2.0)], "prefix string, price double")
    got = joins.by_longest_prefix(d, "name", t, "prefix", [1, 3])
    assert values(got.fillna(-1, ["price"]), "name", "price") == [("m-1-x", 2.0), ("m-2", 1.0), ("z", -1.0)]
    assert figures.total_cost(got, [], F.col("price"), F.lit(1.0)).first()["cost"] is None


def test_budget_skips_and_goes_on(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0), (1, 3, 3.0), (1, 4, 1.0)], "g int, o int, x double")
    assert values(folds.admitted(d, ["g"], "o", "x", 8.0), "o", "x") == [(1, 5.0), (3, 3.0)]
    assert values(folds.packed(d, ["g"], "o", "x", 8.0, 2), "o", "batch") == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_folds_stream_a_large_group(spark):
    """No group is gathered in a row; the state is carried over batches, nulls are skipped."""
    d = spark.range(25_000).select(F.when(F.col("id") % 5 > 0, 1).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 7 > 0, F.lit(1.0)).alias("x"))
    for df in (folds.admitted(d, ["g"], "o", "x", 12_000.0), folds.packed(d, ["g"], "o", "x", 1e9, 3)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {g: [i for i in range(25_000) if (i % 5 > 0) == (g == 1) and i % 7][:12_000] for g in (1, None)}
    got = folds.admitted(d, ["g"], "o", "x", 12_000.0).collect()
    assert {g: sorted(r.o for r in got if r.g == g) for g in want} == want
    assert {(r.g, r.spent) for r in got} == {(g, float(len(w))) for g, w in want.items()}
    batches = {(r.g, r.o): r.batch for r in folds.packed(d, ["g"], "o", "x", 1e9, 3).collect()}
    assert batches == {(g, o): k // 3 for g in want for k, o in enumerate(i for i in range(25_000) if (i % 5 > 0) == (g == 1))}


def test_trees(spark):
    d = spark.createDataFrame([([(0, "a"), (1, "b"), (0, "a")], None)], "new array<struct<depth:int,name:string>>, old array<struct<depth:int,name:string>>")
    r = d.select(trees.new_stages(F.col("old"), F.col("new"), ["name"]).alias("n"), trees.frames_without_child(F.col("new")).alias("f")).first()
    assert [x.name for x in r.n] == ["a", "b", "a"] and [x.name for x in r.f] == ["b", "a"]


def test_chain_roots(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (7, 7)], "a long, b long")
    got = dict(values(graphs.chain_roots(edges, "a", "b"), "node", "root"))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90}


def test_iso_weeks_and_release_over_clock_changes(spark):
    days = spark.createDataFrame([(dt.date(2027, 1, 2),), (dt.date(2024, 12, 30),)], "d date")
    assert [r[0] for r in days.select(dates.iso_week(F.col("d"))).collect()] == ["2026-W53", "2025-W01"]
    # clocks go forward on 31 March 2024, so seven o'clock local time is five o'clock UTC that day
    t = spark.createDataFrame([("2024-03-30 20:00:00",)], "t string").select(dates.next_release(F.to_timestamp_ntz("t"), "Europe/Warsaw", 7).alias("x"))
    assert t.first().x == dt.datetime(2024, 3, 31, 5)


def test_register_keeps_newest_and_first_of_ties(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text('Number of item;Published on;Title\nA1;2024-01-01 10:00;"one\nline"\nA1;2024-02-01 10:00;two\nA1;2024-02-01 10:00;three\n;2024-01-01 10:00;none\nB1;not a date;bad\n')
    got = read_register(spark, str(f), {"number": "number", "published": "published", "title": "title"}, "number", "published")
    assert values(got, "number", "title") == [("A1", "two")]
    with pytest.raises(ValueError):
        mapped_headers(["x"], {"number": "number"}, ["number"])
    (tmp_path / "p.json").write_text('[{"n": "1", "extra": 2}, {"n": "2"}]')
    assert values(read_json_pages(spark, str(tmp_path / "p.json"), "n string"), "n") == [("1",), ("2",)]


def test_excerpts_merge_windows(spark):
    d = spark.createDataFrame([(1, "a" * 50 + "key" + "b" * 10 + "key" + "c" * 50), (2, None), (3, "none")], "k long, t string")
    got = pages.excerpts(d, "k", "t", "key", 8).collect()
    assert [(r.k, r.start, r.end) for r in got] == [(1, 42, 74)]


def test_text_changes(spark):
    d = spark.createDataFrame([(1, "One two. Three four.", "One two. Three five."), (2, "", ""), (3, None, "x")], "k int, a string, b string")
    assert {r.k: (r.changed, r.words) for r in differences.differences(d, ["k"], "a", "b").collect()} == {1: (1, 4), 2: (0, 0), 3: (1, 1)}


def test_items_of_any_length_are_found_in_documents(spark):
    texts = ["aa bb cc dd eeX and more", "aa  bb cc", "x aa bb cc dd ee", None, "", "aa bb cc dd ee ff gg", "xbb cc ddx", "xbb cc ddx"]
    items = ["aa bb cc dd ee", "bb cc dd", "aa bb cc dd ee ff", "b", "", "aa bb", " cc", "zz yy", None, "a bb cc d", "aa  bb", "aa bb cc"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {k: 0 if x is None else sum(t is not None and x in t for t in texts) for k, x in enumerate(items)}
    assert {r.item_id: r.n_docs for r in joins.containing(d, "text", i, "item_id", "text").collect()} == want


def test_numerals_there_and_back(spark):
    d = spark.range(0, 4001).select("id", text.roman_numeral(F.col("id")).alias("r"))
    got = d.withColumn("v", text.roman_value(F.lower("r"))).collect()
    assert all(r.v == (r.id if 1 <= r.id <= 3999 else None) for r in got)
    bad = spark.createDataFrame([("IIII",), ("VX",), ("IC",), ("",), (None,), ("MMMM",), ("I V",)], "r string").select(text.roman_value(F.col("r")).alias("v"))
    assert [r.v for r in bad.collect()] == [None] * 7
    plans = spark.createDataFrame([("by the IV quarter 2031",), ("I / II Quarter 2031",), ("V quarter 2031",), ("the quarter 2031",), (None,)], "p string")
    assert [r.q for r in plans.select(text.planned_quarter(F.col("p")).alias("q")).collect()] == ["2031-Q4", "2031-Q2", None, None, None]
