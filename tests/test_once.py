from pyspark.sql import functions as F

from gristmill.functions import letters
from gristmill.operators import pages
from gristmill.sources.tables import decoded_address


def test_hidden_addresses_work_their_text_out_once(spark):
    assert str(decoded_address(F.upper("x"))).count("upper(x)") == 1
    texts = ["5a3b1a38", "5A3b", "5a", "", None, "5a3b1", "005a00e9", "zz00"]
    want = ["a@b", "a", None, None, None, "a", "Z\0é", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    assert [r.a for r in d.select("i", decoded_address(F.col("x")).alias("a")).orderBy("i").collect()] == want


def test_markup_is_measured_by_runs_and_not_by_words(monkeypatch):
    calls, measure = [], pages._units
    monkeypatch.setattr(pages, "_units", lambda s: calls.append(len(s)) or measure(s))
    html = "".join(f"<b>{'some words here ' * 50}</b>\n" for _ in range(100))
    assert "".join(pages._markup_parts(html, 4096)).replace("</b><b>", "").count("words") == 5000
    assert len(calls) < 2000 and sum(calls) < 3 * len(html)


def test_parts_of_a_text_beyond_one_batch_join(spark):
    d = spark.createDataFrame([(1, "word " * 1_000_000), (2, None), (3, "a b")], "doc_id long, text string").coalesce(1)
    rows = pages.message_parts(d, "doc_id", "text").collect()
    assert "".join(r.body for r in rows if r.doc_id == 1) == "word " * 1_000_000 and [(r.part, r.body) for r in rows if r.doc_id > 1] == [(0, ""), (0, "a b")]


def test_a_letter_is_flattened_once(spark):
    told = letters.consultation(F.upper("x"), {"may": 5}, r"DATED (\S+ \S+ \d{4})", r"IN (\d+) DAYS", r"BY ([^,]+),", r"TO (\S+@\S+)")
    assert str(told).count("upper(x)") == 1
    d = spark.createDataFrame([("dated 3  May 2024 in 9\ndays by 04.05.2024, to a@b",), (None,)], "x string")
    rows = [r.t for r in d.select(told.alias("t")).collect()]
    assert (str(rows[0].written), rows[0].days, str(rows[0].until), rows[0].address) == ("2024-05-03", 9, "2024-05-04", "A@B")
    assert rows[1] == (None, None, None, None)
