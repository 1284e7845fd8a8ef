"""Streams worked off in one go give what a batch gives, and nothing twice."""

import json

from pyspark.sql import functions as F

from gristmill.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_inbox_is_read_once_and_deduplicated(spark, tmp_path):
    inbox, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        s = ingest.read_inbox(spark, inbox, "id long, ts timestamp, v string")
        ingest.run_once(ingest.deduplicated(s, ["id"], "ts", "7 days"), out, check)
        return sorted((r.id, r.v) for r in spark.read.parquet(out).collect())

    put("1.json", {"id": 1, "ts": "2024-01-01 00:00:00", "v": "a"}, {"id": 2, "ts": "2024-01-01 00:00:00", "v": "b"})
    assert run() == [(1, "a"), (2, "b")]
    put("2.json", {"id": 2, "ts": "2024-01-02 00:00:00", "v": "again"}, {"id": 3, "ts": "2024-01-02 00:00:00", "v": "c"})
    assert run() == [(1, "a"), (2, "b"), (3, "c")] and run() == [(1, "a"), (2, "b"), (3, "c")]


def test_weeks_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # a late row closes the weeks before
    end = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    events.union(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.weekly(stream, "ts", "1 day", "event_type"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.week, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.w, r.event_type): r.n for r in events.groupBy(F.date_trunc("week", "ts").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_changes_are_told_once_and_first_sight_is_silent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        s = ingest.read_inbox(spark, str(inbox), "k long, seq long, state string")
        ingest.run_once(ingest.changed_states(s, "k", "state"), out, check)
        return sorted((r.k, r.seq, r.before, r.now) for r in spark.read.parquet(out).collect())

    rows = lambda *r: "".join(json.dumps(dict(zip(("k", "seq", "state"), x, strict=True))) + "\n" for x in r)
    (inbox / "1.json").write_text(rows((1, 1, "new"), (1, 2, "new"), (2, 1, "new")))
    assert run() == []
    (inbox / "2.json").write_text(rows((1, 3, "done"), (2, 2, "new")))
    assert run() == [(1, 3, "new", "done")]


def test_watermark_is_held_back_by_failures(spark):
    runs = spark.createDataFrame([("2024-01-01", True), ("2024-01-05", False)], "started string, ok boolean").withColumn("started", F.to_timestamp("started"))
    assert str(ingest.low_watermark(runs, "started", "ok", "2 days").first().since) == "2023-12-30 00:00:00"
    assert ingest.low_watermark(runs.limit(0), "started", "ok", "2 days").first().since is None
