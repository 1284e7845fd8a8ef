"""Each query against its SQL, on the smallest tables."""

import re

import duckdb
import pytest

from gristmill import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_queries_follow_plain_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = {}
    for r in sorted(queries.QUERIES["message_parts"](spark, SF).collect(), key=lambda r: (r.doc_id, r.part)):
        assert len(r.body.encode("utf-16-le")) // 2 <= 4096
        parts.setdefault(r.doc_id, []).append(r.body)
    assert {d: "".join(p) for d, p in parts.items()} == texts
    for r in queries.QUERIES["keyword_excerpts"](spark, SF).collect():
        assert r.excerpt == texts[r.doc_id][r.start : r.end] and "hand" in r.excerpt.lower()
    for r in queries.QUERIES["text_changes"](spark, SF).collect():
        assert (r.changed_words == 0) == (words(texts[r.doc_id]) == words(texts[r.old_id]))


def test_message_part_counts_hold_all_documents(spark):
    got = {r.doc_id: (r.parts, r.longest) for r in queries.QUERIES["message_part_counts"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == {d for d, t in texts.items() if t}
    for d, (parts, longest) in got.items():
        assert parts >= len(texts[d].encode("utf-16-le")) / 2 / 4096 and longest <= min(4096, len(texts[d])) and (parts == 1) == (longest == len(texts[d]))
    assert max(parts for parts, _ in got.values()) > 1
