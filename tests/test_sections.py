"""Furniture, bodies, letters, recorded cleaning, articles and JSON at any depth on small cases."""

from pyspark.sql import functions as F

from gristmill.functions import json, sections, wording
from gristmill.operators import excerpting, folds, json_trees
from gristmill.process_queries import _CONDITION_KINDS, _ITEMS, _UNTIL


def made(spark, texts, column):
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return [r[0] for r in d.orderBy("k").select(column).collect()]


def test_furniture_goes_from_the_top_alone(spark):
    pages = ["\n - 12 -\nHead\nText\nHead\n3", "Draft of May\nText", "7\n\n", "", None, "12 words"]
    got = made(spark, pages, sections.without_furniture(F.col("t"), F.lit("Head"), "^Draft"))
    assert got[:4] == ["Text\nHead\n3", "Text", "", ""] and got[5] == "12 words"


def test_bodies_end_at_the_first_end(spark):
    texts = ["intro Art. 1. a REASONS x COSTS", "Art. 1. a COSTS REASONS", "Art. 1. all", "none", None]
    assert made(spark, texts, sections.body(F.col("t"), "Art[.] 1[.]", ["REASONS", "COSTS"])) == ["Art. 1. a ", "Art. 1. a ", "Art. 1. all", None, None]


def test_letters_end_where_the_document_begins(spark):
    texts = ["Dear. Yours A\nJUNK ACT one\fACT", "Dear. Yours A\n junk\fnext ACT", "Dear. Yours A\n only", "ACT plain", "far " * 20 + "Yours A ACT", None]
    got = made(spark, texts, sections.without_letter(F.col("t"), "Yours [A-Z]", "ACT", 40))
    assert got == ["ACT one\fACT", "\fnext ACT", "", "ACT plain", texts[4], None]


def test_cleaning_tells_what_it_changed(spark):
    out, kept = sections.cleaned(F.col("t"), [("note", "\\[[0-9]+\\]", ""), ("range", "([0-9]+) *[-–] *([0-9]+)", "$1-$2")])
    texts = ["art. 1 – 3[12] and 4-5", "plain", None]
    assert made(spark, texts, out) == ["art. 1-3 and 4-5", "plain", None]
    assert [[tuple(x) for x in r or []] for r in made(spark, texts, kept)] == [[("note", "[12]", ""), ("range", "1 – 3", "1-3")], [], []]


def test_articles_under_plain_and_quoted_headings(spark):
    text = 'x Art. 1. one "Art. 7. in quotes Art. 2. two Art. 3. three Art. 3. again Art. 4. ' + "long " * 30
    d = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "")], "k long, t string")
    got = {r.number: r.article for r in excerpting.articles(d, "k", "t", '"?Art[.] [0-9]+[.]', "([0-9]+)", '^"', 60).collect()}
    assert got == {"1": 'Art. 1. one "Art. 7. in quotes', "7": '"Art. 7. in quotes', "2": "Art. 2. two"}


def test_names_at_any_depth(spark):
    texts = ['{"a":1,"b":[{"a":"x"},[{"a":{"a":null}}]]}', "[]", "{", "", None, '"a"']
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert sorted((r.k, r.path, r.value) for r in json_trees.named_values(d, ["k"], "t", "a").collect()) == [(0, [], "1"), (0, [1, 0], "x"), (0, [1, 1, 0], '{"a":null}')]


def test_conditions_name_their_points(spark):
    notes = ["Items II to IV, vi and X wait until referred back;", "Waits until amendments are tabled; item X", "Item I. Under rule 152.", None, "Items IIII, V wait until a day; item II"]
    kinds = wording.condition_kind(F.col("t"), _UNTIL, _CONDITION_KINDS, "other")
    assert made(spark, notes, kinds) == ["referred", "amended", None, None, "other"]
    assert made(spark, notes, wording.conditional_items(F.col("t"), _UNTIL, _ITEMS)) == [[2, 3, 4, 6, 10], [], None, None, [5]]


def test_units_travel_with_what_they_refer_to(spark):
    rows = [("a", 1, 4.0, [(3, 3.0)]), ("a", 2, 3.0, None), ("a", 3, 3.0, [(1, 4.0)]), ("a", 4, 30.0, [(1, 4.0)]), ("a", 5, 1.0, []), (None, 1, None, [])]
    d = spark.createDataFrame(rows, "g string, i long, n double, r array<struct<id:long,size:double>>")
    got = {(x.g, x.i): (x.batch, x.added) for x in folds.packed_with_references(d, ["g"], "i", "n", "r", 10).collect()}
    assert got == {("a", 1): (0, 7), ("a", 2): (0, 3), ("a", 3): (0, 0), ("a", 4): (1, 34), ("a", 5): (2, 1), (None, 1): (0, 0)}
    assert folds.packed_with_references(d.limit(0), ["g"], "i", "n", "r", 10).count() == 0
