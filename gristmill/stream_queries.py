"""Streams and readers as queries: each works off a given table as it would arrive, and its SQL is the batch answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.graphs import shared_folder
from gristmill.sources.tables import read_register, register_rejects, table
from gristmill.streaming import changes, ingest, outbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern names one, as a stream reads folders."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "WITH e AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM e WHERE week + 7 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
)
def weekly_stream(spark, sf_dir):
    """Counts by week, given out once the watermark has passed the week's end."""
    where = _scratch(spark, "weekly")
    ingest.run_once(ingest.weekly(_events(spark, sf_dir), "ts", "1 day", "event_type"), f"{where}/out", f"{where}/check")
    return spark.read.schema("week timestamp, event_type string, n long").parquet(f"{where}/out").select(F.to_date("week").alias("week"), "event_type", "n")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def deduplicated_stream(spark, sf_dir):
    """Each user's kinds of events once, however often they come within the time that rows may be late."""
    where = _scratch(spark, "deduplicated")
    once = ingest.deduplicated(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days")
    ingest.run_once(once, f"{where}/out", f"{where}/check")
    out = spark.read.schema("user_id long, event_type string, ts timestamp").parquet(f"{where}/out")
    return out.groupBy("user_id").agg(F.count("*").alias("kinds"))


@query(
    "WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS millis, event_type AS kind FROM events), l AS (SELECT *, lag(kind) OVER w AS was, lag(millis) OVER w AS last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY millis, kind))"
    " SELECT user_id, millis, was, kind FROM l WHERE was <> kind AND millis - last <= 172800000 AND millis <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 86400000"
)
def change_stream(spark, sf_dir):
    """Changes of a user's kind of event up to the watermark, a day behind the last event."""
    where, before = _scratch(spark, "changes"), spark.conf.get(changes.PROVIDER[0])
    spark.conf.set(*changes.PROVIDER)
    try:
        ingest.run_once(changes.changes(_events(spark, sf_dir), "user_id", "ts", "event_type", "1 day", 2 * 86_400), f"{where}/out", f"{where}/check")
    finally:
        spark.conf.set(changes.PROVIDER[0], before)
    out = spark.read.schema("key string, at timestamp, before string, now string").parquet(f"{where}/out")
    return out.select(F.col("key").cast("long").alias("user_id"), F.unix_millis("at").alias("millis"), F.col("before").alias("was"), F.col("now").alias("kind"))


@query("SELECT event_type, count(DISTINCT (user_id, value)) AS messages FROM events WHERE value > 50 GROUP BY 1")
def outbox_stream(spark, sf_dir):
    """Messages of an event's user, kind and value, each once, with a batch that is written twice."""
    where = _scratch(spark, "outbox")
    stream = _events(spark, sf_dir).where("value > 50").select("user_id", "event_type", "value")
    content = ["user_id", "event_type", "value"]
    outbox.deliver(stream, content, f"{where}/out", f"{where}/check")
    schema = "user_id long, event_type string, value double, message_key string"
    # what a run that died before its commit would do: the last batch again
    again = outbox.sent(spark, f"{where}/out", schema)
    last = again.agg(F.max("batch")).first()[0]
    rows = table(spark, sf_dir, "events").where("value > 50").select(*content)
    outbox.put(rows, last, content, f"{where}/out")
    return outbox.sent(spark, f"{where}/out", schema).groupBy("event_type").agg(F.count("*").alias("messages"))


_REGISTER = {"number": "number", "title": "title", "made": "made"}


def _register(spark, sf_dir) -> str:
    """Customers as a register in CSV: quoted titles over two lines, numbers that repeat or are missing, days that are none."""
    where, k = _scratch(spark, "register"), F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.when(k % 11 == 0, "").otherwise((k - k % 2).cast("string")).alias("Number of entry"), F.concat(F.lit('say "'), "c_name", F.lit('";\nmore')).alias("Title"),
        F.when(k % 7 == 0, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit(" 10:00"))).alias("Made on"),
    )
    c.coalesce(1).write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(where)
    return where


@query(
    "WITH r AS (SELECT c_custkey AS k, c_custkey - c_custkey % 2 AS number, c_name, 1 + c_custkey % 28 AS day FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0) SELECT number::VARCHAR AS number, 'say \"' || c_name || '\";' || chr(10) || 'more' AS title, day FROM r QUALIFY row_number() OVER (PARTITION BY number ORDER BY day DESC, k) = 1"
)
def register_rows(spark, sf_dir):
    r = read_register(spark, _register(spark, sf_dir), _REGISTER, "number", "made")
    return r.select("number", "title", F.dayofmonth("made").cast("long").alias("day"))


@query("SELECT CASE WHEN c_custkey % 11 = 0 THEN 'no key' ELSE 'no date' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0 GROUP BY 1")
def register_losses(spark, sf_dir):
    return register_rejects(spark, _register(spark, sf_dir), _REGISTER, "number", "made").groupBy("reason").agg(F.count("*").alias("n"))
