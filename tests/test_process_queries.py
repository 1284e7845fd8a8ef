"""Each query over processes, listings, wording and JSON against its SQL, and the edge cases of their operators."""

import pytest
from pyspark.sql import functions as F

from gristmill import process_queries, queries
from gristmill.functions import json, wording
from gristmill.operators import folds, keyed, matching, stages
from tests.test_queries import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(process_queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = process_queries.QUERIES[name](spark, SF), duck.sql(process_queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(want.columns, want.fetchall()) and found


def test_names_are_not_taken_twice():
    assert not set(process_queries.QUERIES) & set(queries.QUERIES)


def test_broken_json_tells_nothing(spark):
    d = spark.createDataFrame([(None,), ("{",), ("[]",), ('{"a":[],"b":"true"}',), ('{"a":[1],"b":true}',)], "j string")
    got = d.select(json.has_items(F.col("j"), "$.a").alias("a"), json.is_true(F.col("j"), "$.b").alias("b")).collect()
    assert [r.a for r in got] == [False] * 4 + [True] and [r.b for r in got][:3] == [False] * 3
    assert json.listed(d, "j", "$.a", "int").select("pos", "item").collect() == [(0, 1)]


def test_stages_in_order_at_any_depth(spark):
    tree = [(1, [0], "a"), (1, [0, 1], "b"), (1, [0, 1, 0], "c"), (1, [0, 0], "d"), (1, [1], "e"), (2, [0], "a")]
    d = spark.createDataFrame([(p, [int(x) for x in path], n) for p, path, n in tree], "p int, path array<int>, n string")
    assert [r.n for r in stages.in_order(d, ["p"]).where("p = 1").orderBy("place").collect()] == ["a", "d", "b", "c", "e"]
    assert sorted(r.n for r in stages.told(d, ["p"]).collect()) == ["a", "c", "d", "e"]
    prints = {r.p: r.fingerprint for r in stages.stage_prints(d.union(d.where("p = 2").withColumn("p", F.lit(3))), ["p"], [F.col("n")]).collect()}
    assert prints[2] == prints[3] != prints[1]
    assert stages.phases(d.limit(0), ["p"], "n", "n", {("x", "a"): "y"}, "x").count() == 0


def test_a_quote_is_found_whatever_its_spacing(spark):
    d = spark.createDataFrame([("say (a+b)  or\n c.", "(a+b) or c."), ("x", "y"), ("x", " "), (None, "x")], "s string, q string")
    assert [r.at for r in d.select(wording.quoted_at(F.col("s"), F.col("q")).alias("at")).collect()] == [5, 0, None, None]
    keys = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a=", None)], "x string, y string").select(wording.content_key(F.col("x"), F.col("y")).alias("k"))
    assert keys.distinct().count() == 4
    amounts = spark.createDataFrame([(0.0,), (0.004,), (1234567.891,), (None,)], "x double").select(wording.money(F.col("x")).alias("m"))
    assert [r.m for r in amounts.collect()] == ["$0.00", "<$0.01", "$1,234,567.89", None]


def test_listings_meet_what_is_known(spark):
    known = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "id int, name string")
    listed = spark.createDataFrame([(1, "z"), (9, "x"), (8, "y"), (7, None), (None, "x")], "id int, name string")
    got = {(r.id, r.name): r.state for r in matching.discovered(listed, known, "id", F.col("name"), F.col("name")).collect()}
    assert got == {(1, "z"): "known", (9, "x"): "renumbered", (8, "y"): "new", (7, None): "new", (None, "x"): "renumbered"}
    d = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 6.0), (1, 11.0), (1, 12.0), (2, 3.0), (2, None)], "g int, x double")
    assert sorted((r.g, r.x, r.bundle) for r in folds.bundled(d, ["g"], "x", 5.0).collect()) == [(1, 0.0, 0), (1, 5.0, 0), (1, 6.0, 1), (1, 11.0, 1), (1, 12.0, 2), (2, 3.0, 0)]
    a, b = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k int, v int"), spark.createDataFrame([(2, None), (3, 4), (5, None)], "k int, v int")
    assert {r.k: r.state for r in keyed.compared(a, b, ["k"], "v").collect()} == {1: "gone", 2: "unchanged", 3: "changed", 5: "new"}
