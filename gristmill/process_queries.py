"""Queries over processes, listings, wording and JSON, each with SQL that must give the same rows."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import json, projection, sections, text, wording
from gristmill.functions.once import once
from gristmill.operators import decisions, excerpting, folds, json_trees, keyed, matching, ranking, stages
from gristmill.sources.tables import decoded_address, masked, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _at(x: str):
    return F.lit(x).cast("timestamp_ntz")


# -- JSON ----------------------------------------------------------------------------

#: An object with a list, a flag and a value to drop, made of an event.
_BODY = """SELECT event_id, event_type, '{"tags":[' || CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id % 7 || ',' || event_id % 5 END || '],"ok":' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ',"old":' || (props->>'$.k') || '}' AS body FROM events"""


def _bodies(spark, sf_dir):
    i = F.col("event_id")
    tags = F.when(i % 3 == 0, "").otherwise(F.concat_ws(",", (i % 7).cast("string"), (i % 5).cast("string")))
    ok = F.when(i % 4 == 0, "true").when(i % 4 == 1, "false").otherwise("null")
    body = F.concat(F.lit('{"tags":['), tags, F.lit('],"ok":'), ok, F.lit(',"old":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", body.alias("body"))


@query(f"SELECT event_type, count(*) FILTER (json_array_length(body->'$.tags') > 0) AS with_tags, count(*) FILTER ((body->>'$.ok') = 'true') AS ok, count(*) FILTER (json_array_length(body->'$.none') > 0) AS with_none FROM ({_BODY}) GROUP BY 1")
def json_tests(spark, sf_dir):
    b = F.col("body")
    return _bodies(spark, sf_dir).groupBy("event_type").agg(F.count_if(json.has_items(b, "$.tags")).alias("with_tags"), F.count_if(json.is_true(b, "$.ok")).alias("ok"), F.count_if(json.has_items(b, "$.none")).alias("with_none"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN body->>'$.old' ELSE body->>'$.tags' END AS value FROM ({_BODY})")
def json_value_by_name(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, "old").otherwise("tags")
    return _bodies(spark, sf_dir).select("event_id", json.value_at(F.col("body"), name).alias("value"))


@query(f"SELECT event_id, array_to_string(list_filter(json_keys(body), lambda x: x <> 'old'), ',') AS names FROM ({_BODY})")
def json_without_key(spark, sf_dir):
    left = json.without_keys(F.col("body"), "old")
    return _bodies(spark, sf_dir).select("event_id", F.array_join(F.map_keys(left), ",").alias("names"))


@query(f"SELECT event_type, item, count(*) AS n, sum(pos)::BIGINT AS places FROM (SELECT event_type, unnest((body->'$.tags')::BIGINT[]) AS item, unnest(range(json_array_length(body->'$.tags')::BIGINT)) AS pos FROM ({_BODY})) GROUP BY ALL")
def json_exploded(spark, sf_dir):
    rows = json.listed(_bodies(spark, sf_dir), "body", "$.tags", "bigint")
    return rows.groupBy("event_type", "item").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


_IDS = "[" + ",".join(str(3 * k) for k in range(1, 60)) + ",3]"


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT unnest('{_IDS}'::JSON::BIGINT[]))")
def rows_of_json_list(spark, sf_dir):
    ids = json.listed(spark.createDataFrame([(_IDS,)], "ids string"), "ids", "$", "bigint", "o_orderkey").select("o_orderkey").distinct()
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey").select("o_orderkey", "o_totalprice")


# -- predicates ------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def name_prefix(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08 06:00:00' AND ts < TIMESTAMP '2024-01-15 06:00:00' GROUP BY 1")
def half_open_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("ts") >= _at("2024-01-08 06:00:00")) & (F.col("ts") < _at("2024-01-15 06:00:00")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE julian(ts) < julian(TIMESTAMP '2024-01-10 12:00:00')")
def moments_before(spark, sf_dir):
    # the moments are told as texts of two layouts, so they are compared as moments
    told = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    read = F.coalesce(F.try_to_timestamp(told, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), F.try_to_timestamp(told, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return table(spark, sf_dir, "events").where(read.cast("timestamp_ntz") < _at("2024-01-10 12:00:00")).select("event_id")


# -- joins -----------------------------------------------------------------------------


@query("SELECT c_nationkey IS NOT NULL AS owned, count(*) AS n, count(DISTINCT c_nationkey) AS owners FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey GROUP BY 1")
def optional_owner(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy(F.isnotnull("c_nationkey").alias("owned")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("owners"))


@query("WITH m AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_partkey - p_partkey % 10 END, p_partkey) AS t FROM part) SELECT a.p_partkey, count(b.p_partkey) AS others FROM m a LEFT JOIN m b ON a.t = b.t AND a.p_partkey <> b.p_partkey GROUP BY 1")
def partners(spark, sf_dir):
    k = F.col("p_partkey")
    return matching.partners(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", F.when(k % 3 == 0, k - k % 10)).select("p_partkey", "others")


@query("SELECT n_nationkey AS c_nationkey, s.c_mktsegment, min(c.c_custkey) AS c_custkey FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 5000 GROUP BY ALL")
def first_of_each(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return matching.first_of_each(n, c.select("c_mktsegment"), c.where("c_acctbal > 5000"), ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_totalprice > 450000)")
def group_expansion(spark, sf_dir):
    return matching.whole_groups_of(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], F.col("o_totalprice") > 450000).select("o_orderkey")


@query("SELECT CASE WHEN o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') THEN 'again' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def revived_skips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    by = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    return matching.revived(o, ["o_custkey"], "status", "F", "again", by).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "WITH k AS (SELECT p_partkey AS id, lower(p_name) || '/' || p_size || '/' || p_brand AS name FROM part WHERE p_partkey % 3 <> 0), one AS (SELECT name FROM k GROUP BY 1 HAVING count(*) = 1)"
    ", r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 1000000 END AS id, lower(p_name) || '/' || p_size || '/' || p_brand AS name FROM part)"
    " SELECT CASE WHEN id IN (SELECT id FROM k) THEN 'known' WHEN name IN (SELECT name FROM one) THEN 'renumbered' ELSE 'new' END AS state, count(*) AS n FROM r GROUP BY 1"
)
def register_discovery(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("name", F.concat_ws("/", "p_name", "p_size", "p_brand"))
    known = p.where(k % 3 != 0).select(k.alias("id"), "name")
    listed = p.select(F.when(k % 2 == 0, k).otherwise(k + 1000000).alias("id"), "name")
    return matching.discovered(listed, known, "id", F.lower("name"), F.lower("name")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'updated' END AS state FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 4 <> 1")
def modified_since(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    k = F.col("o_orderkey")
    stored = o.where(k % 4 != 0).withColumn("modified", F.when(k % 4 == 1, F.col("modified")).otherwise(F.col("modified") - F.expr("INTERVAL 1 DAY")))
    return matching.modified_since(o, stored, "o_orderkey", "modified", _at("2000-01-01")).select("o_orderkey", "state")


@query("SELECT c_custkey, o_orderdate::DATE::VARCHAR AS day, min(o_orderkey) AS listing FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY ALL")
def meetings_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    return matching.meetings(c, o, "c_custkey", ["day"], F.asc("o_orderkey")).select("c_custkey", "day", F.col("o_orderkey").alias("listing"))


@query("WITH p AS (SELECT *, lag(o_orderdate::DATE) OVER w AS d, lag(o_orderstatus) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, CASE WHEN s = 'F' AND o_orderdate::DATE - d <= 60 THEN d END::VARCHAR AS was FROM p WHERE o_orderstatus <> 'F'")
def moved_meetings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    got = matching.moved_from(o, "o_custkey", "day", "o_orderkey", F.col("o_orderstatus") == "F", 60)
    return got.select("o_orderkey", F.col("was").cast("string").alias("was"))


@query("WITH a AS (SELECT p_name || p_size AS name, min(p_partkey) AS watch FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p_name || p_size AS name, min(p_partkey) AS number FROM part WHERE p_partkey % 2 = 1 GROUP BY 1 HAVING count(*) = 1) SELECT watch, number FROM a JOIN b USING (name)")
def linked_watches(spark, sf_dir):
    p, name = table(spark, sf_dir, "part"), F.concat("p_name", F.col("p_size").cast("string"))
    even, odd = p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "watch"), p.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "number")
    return matching.linked_watches(even, odd, "watch", "number", name, name)


@query("SELECT CASE WHEN c_nationkey = 3 AND (c_mktsegment, c_custkey % 40) NOT IN (SELECT (c_mktsegment, c_custkey % 40) FROM customer WHERE c_nationkey = 4) THEN 4 ELSE c_nationkey END AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def moved_owners(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("slot", F.col("c_custkey") % 40)
    return matching.moved_owners(c, "c_nationkey", ["c_mktsegment", "slot"], 3, 4).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01')")
def prunable_payloads(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= _at("1997-06-01"))
    got = matching.prunable(o, li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderdate", _at("1998-01-01"))
    return got.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'discontinued' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def term_rollover(spark, sf_dir):
    old = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") < _at("1999-01-01"))
    return table(spark, sf_dir, "orders").groupBy(F.when(old, "discontinued").otherwise(F.col("o_orderstatus")).alias("status")).agg(F.count("*").alias("n"))


# -- rollups and order -------------------------------------------------------------------


@query("SELECT n_regionkey, n_name, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_name)::INT AS place FROM (SELECT n_regionkey, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)")
def signatory_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = s.join(table(spark, sf_dir, "nation"), "n_nationkey")
    return rows.select("n_regionkey", "n_name", "n", F.row_number().over(ranking.Window.partitionBy("n_regionkey").orderBy(F.desc("n"), F.asc("n_name"))).alias("place"))


@query("SELECT o_orderstatus, CASE WHEN d < 365 THEN 'year' WHEN d < 1000 THEN 'years' ELSE 'old' END AS age, count(*) AS n, max(d)::INT AS oldest FROM (SELECT o_orderstatus, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS d FROM orders) GROUP BY ALL")
def intent_ages(spark, sf_dir):
    days = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    age = decisions.first_rule([(days < 365, "year"), (days < 1000, "years")], "old")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", age.alias("age")).agg(F.count("*").alias("n"), F.max(days).alias("oldest"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) AS newest, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS textless")
def status_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("newest"))
    o = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    d = table(spark, sf_dir, "documents").agg(F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("textless"))
    return o.crossJoin(e).crossJoin(d)  # three rows of one table each


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value::DECIMAL(18,2)), 2)::DOUBLE AS spent, count(*) AS calls FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-17' GROUP BY 1 ORDER BY spent DESC, day LIMIT 5")
def spend_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= _at("2024-01-17")))
    days = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("spent"), F.count("*").alias("calls"))
    return ranking.top(days, [F.desc("spent"), F.asc("day")], 5)


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, count(*) DESC, event_type)::INT AS place FROM events GROUP BY 1")
def display_order(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    fixed = F.array_position(F.array(F.lit("signup"), F.lit("purchase")), F.col("event_type"))
    order = ranking.Window.orderBy(F.when(fixed > 0, fixed).otherwise(3), F.desc("n"), F.asc("event_type"))
    return n.select("event_type", "n", F.row_number().over(order).alias("place"))  # a handful of groups


@query("SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'text' WHEN l_returnflag = 'A' THEN 'reasons' ELSE 'letter' END AS role, arg_min(l_partkey, (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, -l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY ALL")
def role_pick(spark, sf_dir):
    role = decisions.first_rule([(F.col("l_returnflag") == "N", "text"), (F.col("l_returnflag") == "A", "reasons")], "letter")
    final = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    order = F.struct(final.alias("a"), (-F.col("l_linenumber")).alias("b"), F.col("l_partkey").alias("c"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", role.alias("role")).agg(F.min_by("l_partkey", order).alias("l_partkey"))


@query("WITH b AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase' AND value > 60) AS stop FROM events GROUP BY 1) SELECT user_id, max(event_id) FILTER (event_type = 'click' AND (stop IS NULL OR event_id < stop)) AS latest FROM events JOIN b USING (user_id) GROUP BY 1")
def latest_before_barrier(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stop = e.groupBy("user_id").agg(F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("event_id"))).alias("stop"))
    early = (F.col("event_type") == "click") & (F.col("stop").isNull() | (F.col("event_id") < F.col("stop")))
    return e.join(stop, "user_id").groupBy("user_id").agg(F.max(F.when(early, F.col("event_id"))).alias("latest"))


@query("WITH v AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN count(*) FILTER (l_shipdate = d) = 1 THEN min(l_linenumber) FILTER (l_shipdate = d) END AS newest, CASE WHEN count(*) FILTER (l_shipdate = d) = 1 THEN 'dated' ELSE 'ambiguous' END AS why FROM lineitem JOIN v USING (l_orderkey) GROUP BY 1")
def newest_version(spark, sf_dir):
    # the newest of a set decides only if no other is as new
    by_day = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("line"))
    last = by_day.groupBy("l_orderkey").agg(F.max_by(F.struct("n", "line"), "l_shipdate").alias("x"))
    return last.select("l_orderkey", F.when(F.col("x.n") == 1, F.col("x.line")).alias("newest"), F.when(F.col("x.n") == 1, "dated").otherwise("ambiguous").alias("why"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(DISTINCT k) AS rejected FROM (SELECT ts, user_id AS k FROM events WHERE event_type = 'error' UNION ALL SELECT ts, event_id % 100 FROM events WHERE value < 1) GROUP BY 1")
def rejected_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = F.array_compact(F.array(F.when(F.col("event_type") == "error", F.col("user_id")), F.when(F.col("value") < 1, F.col("event_id") % 100)))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return e.select(week.alias("week"), F.explode(keys).alias("k")).groupBy("week").agg(F.count_distinct("k").alias("rejected"))


@query(
    "WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), p AS (SELECT doc_id, i <= len(w) // 2 AS early, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM l)), f AS (SELECT doc_id, x, min(i) AS i, bool_or(early) AS early FROM p GROUP BY 1, 2)"
    " SELECT l.doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (early), '') AS once, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT early), '') AS fresh FROM l LEFT JOIN f ON f.doc_id = l.doc_id WHERE w IS NOT NULL GROUP BY 1"
)
def order_kept(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    half = F.floor(F.size("w") / 2).cast("int")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", w.alias("w"))
    d = d.select("doc_id", F.slice("w", F.lit(1), half).alias("a"), F.slice("w", half + 1, F.size("w")).alias("b"))
    return d.select("doc_id", F.array_join(F.array_distinct("a"), " ").alias("once"), F.array_join(F.array_except("b", "a"), " ").alias("fresh"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"[^\"]*?(\\d+)', 1)::BIGINT[])), ',') AS numbers FROM pages".replace("\\\\", "\\"))
def derived_numbers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(wording.derived_numbers(F.col("html"), r'href="[^"]*?(\d+)'), ",").alias("numbers"))


# -- wording ---------------------------------------------------------------------------------


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), i AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-Z]')) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM l) SELECT doc_id, item, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM i GROUP BY ALL")
def continued_items(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return stages.continued(lines, ["doc_id"], "pos", F.col("line").rlike("^[A-Z]")).groupBy("doc_id", "item").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT kind, short, count(*) AS n FROM (SELECT CASE WHEN starts_with(t, 'large') THEN 'body' WHEN starts_with(t, 'small r') THEN 'ring' ELSE 'other' END AS kind, upper(r[1]) || substr(r, 2) AS short FROM (SELECT lower(p_name) AS t, trim(regexp_replace(p_name, '(?i)^\\s*(?:(?:large|small|red)\\s+)+', '')) AS r FROM part)) GROUP BY ALL".replace("\\\\", "\\"))
def titles(spark, sf_dir):
    t = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "))
    kind = wording.by_opening(t, [("large", "body"), ("small r", "ring")], "other")
    short = F.regexp_replace(wording.short_title(t, ["large", "small", "red"]), " +", " ")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind"), short.alias("short")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN len(w) >= 8 THEN position(array_to_string(w[4:8], ' ') IN t)::INT END AS at FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)".replace("\\\\", "\\"))
def recovered_quotes(spark, sf_dir):
    # the quote's spacing was lost; its place is told in the text with single spaces, as the SQL counts
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    quote = F.array_join(F.slice(words, 4, 5), " \n ")
    d = table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"), words.alias("words"), quote.alias("quote"))
    return d.select("doc_id", F.when(F.size("words") >= 8, wording.quoted_at(F.col("plain"), F.col("quote"))).alias("at"))


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 40 WHEN o_orderpriority = '1-URGENT' THEN o_orderdate::DATE + 7 WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate::DATE + 21 END, '%Y-%m-%d') AS due FROM orders")
def letter_deadlines(spark, sf_dir):
    day, p = F.to_date("o_orderdate"), F.col("o_orderpriority")
    days = F.when(p == "1-URGENT", 7).when(p != "5-LOW", 21)
    due = wording.deadline(F.when(F.col("o_orderstatus") == "O", F.date_add(day, 40)), day, days)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(due, "yyyy-MM-dd").alias("due"))


@query("SELECT lang, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, '$' || format('{:,.2f}', sum(ceil(length(text) / 4.0)) * 0.75) AS cost FROM documents GROUP BY 1")
def estimated_costs(spark, sf_dir):
    n = F.sum(wording.estimated_tokens(F.length("text")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("tokens"), wording.money(n * 0.75).alias("cost"))


@query("SELECT count(DISTINCT (o_custkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END)) AS keys, count(*) AS n FROM orders")
def content_keys(spark, sf_dir):
    key = wording.content_key(F.col("o_custkey"), F.col("o_orderstatus"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").agg(F.count_distinct(key).alias("keys"), F.count("*").alias("n"))


@query("SELECT p_partkey, ['', 'X', 'XX', 'XXX', 'XL', 'L'][p_size // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] AS numeral, p_size AS value FROM part")
def numeral_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.roman_numeral(F.col("p_size")).alias("numeral"))
    return p.withColumn("value", text.roman_value(F.col("numeral")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter FROM orders")
def order_quarters(spark, sf_dir):
    numeral = text.roman_numeral(F.quarter("o_orderdate"))
    told = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("I / ")).otherwise(F.lit("due ")), numeral, F.lit(" quarter "), F.year("o_orderdate").cast("string"), F.lit(" at best"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.planned_quarter(told).alias("quarter"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@site.org' AS address FROM customer")
def customer_addresses(spark, sf_dir):
    address = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@site.org"))
    # a byte a character, as far as Latin-1 goes
    plain = once(address, lambda a: F.hex(F.encode(F.when(a.rlike(r"^[\x00-\xff]*$"), a), "ISO-8859-1")))
    hidden = F.concat(F.lit("5a"), F.lower(masked(plain, F.lit("5a"))))
    return table(spark, sf_dir, "customer").select("c_custkey", decoded_address(hidden).alias("address"))


# -- stages ----------------------------------------------------------------------------------

#: A process a customer: its orders, and what became of each, are its stages.
_STAGES = (
    "SELECT c_custkey AS process, c_name AS name, [0]::BIGINT[] AS path FROM customer UNION ALL SELECT o_custkey, o_orderpriority, [0, o_orderkey]::BIGINT[] FROM orders"
    " UNION ALL SELECT o_custkey, o_orderstatus, [0, o_orderkey, 0]::BIGINT[] FROM orders WHERE o_orderstatus <> 'P'"
)


def _stages(spark, sf_dir):
    c, o = (table(spark, sf_dir, t) for t in ("customer", "orders"))
    path = lambda *c: F.array(*[F.col(x).cast("long") if isinstance(x, str) else F.lit(x).cast("long") for x in c]).alias("path")
    return (
        c.select(F.col("c_custkey").alias("process"), F.col("c_name").alias("name"), path(0))
        .union(o.select("o_custkey", "o_orderpriority", path(0, "o_orderkey")))
        .union(o.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderstatus", path(0, "o_orderkey", 0)))
    )


@query(f"SELECT process, name, (row_number() OVER (PARTITION BY process ORDER BY path) - 1)::INT AS place, (len(path) - 1)::INT AS depth FROM ({_STAGES})")
def stage_order(spark, sf_dir):
    return stages.in_order(_stages(spark, sf_dir), ["process"]).select("process", "name", "place", "depth")


@query(f"SELECT process, count(*) AS stages, sha256(string_agg(sha256((len(path) - 1) || chr(31) || '=' || name), '' ORDER BY path)) AS fingerprint FROM ({_STAGES}) GROUP BY 1")
def stage_fingerprints(spark, sf_dir):
    return stages.stage_prints(_stages(spark, sf_dir), ["process"], [F.col("name")])


@query(f"SELECT process, name FROM (SELECT *, lead(len(path)) OVER (PARTITION BY process ORDER BY path) AS n FROM ({_STAGES})) WHERE n IS NULL OR n <= len(path)")
def told_stages(spark, sf_dir):
    return stages.told(_stages(spark, sf_dir), ["process"]).select("process", "name")


_E = "SELECT user_id, event_id, event_type AS t, value AS v FROM events"


@query(
    f"WITH s AS (SELECT user_id, event_id % 10 AS lane, event_id, CASE WHEN t = 'purchase' AND v > 70 THEN 'adopted' WHEN t = 'error' AND v > 30 THEN 'rejected' WHEN t = 'signup' AND v < 10 THEN 'withdrawn' END AS sign, CASE WHEN t = 'view' THEN v > 50 END AS flag FROM ({_E}))"
    ", p AS (SELECT user_id, lane, arg_max(sign, event_id) FILTER (sign IS NOT NULL) AS sign, bool_or(flag) AS flag FROM s GROUP BY ALL)"
    " SELECT user_id, lane, coalesce(sign, CASE WHEN flag THEN 'passed' WHEN NOT flag THEN 'rejected' END, 'unknown') AS evidence, CASE WHEN sign IS NOT NULL THEN 'stage' WHEN flag IS NOT NULL THEN 'flag' ELSE 'none' END AS source FROM p"
)
def stage_evidence(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    e = table(spark, sf_dir, "events").withColumn("lane", F.col("event_id") % 10)
    signs = [((t == "purchase") & (v > 70), "adopted"), ((t == "error") & (v > 30), "rejected"), ((t == "signup") & (v < 10), "withdrawn")]
    return stages.evidence(e, ["user_id", "lane"], "event_id", signs, F.when(t == "view", v > 50))


@query(
    f"SELECT event, tags, count(*) AS n FROM (SELECT CASE WHEN t = 'purchase' AND v > 50 THEN 'passed' WHEN t = 'error' THEN 'failed' WHEN v > 80 THEN 'step' ELSE 'other' END AS event"
    f", concat_ws(',', CASE WHEN v > 80 THEN 'large' END, CASE WHEN t IN ('error', 'purchase') THEN 'decisive' END, CASE WHEN event_id % 2 = 0 AND NOT coalesce(v > 80, false) THEN 'large' END) AS tags FROM ({_E})) GROUP BY ALL"
)
def event_names(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    names = [((t == "purchase") & (v > 50), "passed"), (t == "error", "failed"), (v > 80, "step")]
    tags = [(v > 80, "large"), (t.isin("error", "purchase"), "decisive"), (F.col("event_id") % 2 == 0, "large")]
    return stages.named(table(spark, sf_dir, "events"), names, tags, "other").groupBy("event", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


_MOVES = {("new", "signup"): "open", ("open", "view"): "seen", ("seen", "click"): "asked", ("asked", "purchase"): "done", ("asked", "error"): "open", ("seen", "error"): "open", ("done", "error"): "closed"}


@query(
    f"WITH RECURSIVE m(p, s, q) AS (VALUES {', '.join(f"('{p}', '{s}', '{q}')" for (p, s), q in _MOVES.items())}), o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({_E}))"
    ", f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'new' AS phase, 0 AS moved FROM o UNION ALL SELECT o.user_id, o.i, coalesce(m.q, f.phase), f.moved + (m.q IS NOT NULL)::INT FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1 LEFT JOIN m ON m.p = f.phase AND m.s = o.t)"
    " SELECT user_id, arg_max(phase, i) AS phase, max(moved)::INT AS moved FROM f GROUP BY 1"
)
def next_phases(spark, sf_dir):
    return stages.phases(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", _MOVES, "new")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate::DATE <= DATE '2000-06-15' AND (CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE + 30 END IS NULL OR o_orderdate::DATE + 30 >= DATE '2000-06-15')")
def open_windows(spark, sf_dir):
    day, today = F.to_date("o_orderdate"), F.lit("2000-06-15").cast("date")
    ends = F.when(F.col("o_orderpriority") != "5-LOW", F.date_add(day, 30))
    begun = F.col("o_orderdate") < _at("2000-06-16")
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & begun & (day <= today) & (ends.isNull() | (ends >= today))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate::DATE IN (DATE '1998-06-16', DATE '1998-06-18', DATE '1998-06-22')")
def hearings_due(spark, sf_dir):
    # bounds on the column itself reach the scan
    days = (_at(f"1998-06-{15 + n}") for n in (1, 3, 7))
    due = functools.reduce(operator.or_, [(F.col("l_shipdate") >= d) & (F.col("l_shipdate") < d + F.expr("INTERVAL 1 DAY")) for d in days])
    return table(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == "O") & due).select("l_orderkey", "l_linenumber", "l_partkey")


# -- decisions -----------------------------------------------------------------------------------


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN length(text) < 200 THEN 'too short' WHEN NOT contains(lower(text), 'the') THEN 'no word' WHEN len(regexp_extract_all(lower(text), 'the')) < 5 THEN 'too few' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1")
def miss_reasons(spark, sf_dir):
    t = F.col("text")
    hits = F.regexp_count(F.lower(t), F.lit("the"))
    rules = [(t.isNull() | (F.trim(t) == ""), "no text"), (F.length(t) < 200, "too short"), (hits == 0, "no word"), (hits < 5, "too few")]
    return table(spark, sf_dir, "documents").groupBy(decisions.first_rule(rules, "accepted").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT settled, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'open' WHEN toxic = 1 AND length(text) >= 100 THEN 'rejected' WHEN quality = 1 AND length(text) >= 500 THEN 'settled' ELSE 'unsure' END AS settled FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def review_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    size = F.length("text")
    rules = [(F.col("seen").isNull(), "open"), ((F.col("toxic") == 1) & (size >= 100), "rejected"), ((F.col("quality") == 1) & (size >= 500), "settled")]
    return d.groupBy(decisions.first_rule(rules, "unsure").alias("settled")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id, max(ts) FILTER (event_type = 'signup' AND value > 30) AS last FROM events GROUP BY 1) SELECT user_id, coalesce(date_diff('day', last::DATE, DATE '2024-01-31') >= 7, true) AS full_pass FROM f")
def full_passes(spark, sf_dir):
    last = F.max(F.when((F.col("event_type") == "signup") & (F.col("value") > 30), F.to_date("ts")))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("last"))
    return e.select("user_id", F.coalesce(F.datediff(F.lit("2024-01-31").cast("date"), "last") >= 7, F.lit(True)).alias("full_pass"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, event_id, i, ts AS first, 0 AS bundle FROM o WHERE i = 1"
    " UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN o.ts - f.first > INTERVAL 6 HOUR THEN o.ts ELSE f.first END, f.bundle + CASE WHEN o.ts - f.first > INTERVAL 6 HOUR THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) SELECT user_id, event_id, bundle FROM f"
)
def timed_bundles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return folds.bundled(e, ["user_id"], "at", 6 * 3600 * 1_000_000).select("user_id", "event_id", "bundle")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN n.l_partkey IS NULL THEN 'gone' WHEN o.l_partkey IS NULL THEN 'new' WHEN n.d = o.d THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity)::BIGINT AS d FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2, 3) o FULL JOIN (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS d FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1, 2, 3) n USING (l_orderkey, l_linenumber, l_partkey)) GROUP BY 1")
def compared_versions(spark, sf_dir):
    li, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    amount = lambda x: F.sum(x).cast("long").alias("d")
    old = li.where("l_partkey % 5 <> 0").groupBy(*keys).agg(amount(F.col("l_quantity")))
    new = li.where("l_partkey % 7 <> 0").groupBy(*keys).agg(amount(F.col("l_quantity") + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)))
    return keyed.compared(old, new, keys, "d").groupBy("state").agg(F.count("*").alias("n"))


# -- excerpts, conditions ------------------------------------------------------------------------

#: Heads of 200 characters, 40 around each match, 1,000 in all, the first head filled up.
_EXCERPTS = r"""WITH d AS (SELECT doc_id, text, length(text) AS n, least(length(text), 200) AS h1, CASE WHEN contains(text, chr(10)) THEN strpos(text, chr(10)) - 1 END AS h2a, string_split_regex(text, '[Hh]and') AS p, len(regexp_extract_all(text, '[Hh]and')) AS k FROM documents WHERE text IS NOT NULL),
 e AS (SELECT *, CASE WHEN h2a IS NOT NULL THEN least(h2a + 200, n) END AS h2b FROM d),
 s AS (SELECT * EXCLUDE (p), (list_sum(list_transform(p[1:i], lambda x: length(x))) + 4 * (i - 1))::BIGINT AS st FROM (SELECT doc_id, n, h1, h2a, h2b, p, unnest(range(1, k + 1)) AS i FROM e)),
 w AS (SELECT *, greatest(st - 40, 0) AS a, least(st + 44, n) AS b FROM s),
 f AS (SELECT *, greatest(a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), h1) AS fr FROM w),
 g AS (SELECT *, sum(greatest(b - fr, 0) - CASE WHEN h2a IS NOT NULL AND fr < b THEN greatest(least(b, h2b) - greatest(fr, h2a), 0) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) + h1 + CASE WHEN h2a IS NOT NULL THEN greatest(h2b - greatest(h2a, h1), 0) ELSE 0 END AS used FROM f),
 r AS (SELECT doc_id, 0 AS a, h1 AS b FROM e UNION ALL SELECT doc_id, h2a, h2b FROM e WHERE h2a IS NOT NULL UNION ALL SELECT doc_id, a, b FROM g WHERE used <= 1000),
 t AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS apart FROM r),
 v AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM t) GROUP BY doc_id, g),
 y AS (SELECT doc_id, a, CASE WHEN a = 0 THEN least(b + greatest(1000 - (sum(b - a) OVER (PARTITION BY doc_id))::BIGINT, 0), n) ELSE b END AS b, text FROM v JOIN d USING (doc_id)),
 z AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS apart FROM y),
 c AS (SELECT doc_id, min(a) AS a, max(b) AS b, any_value(text) AS text FROM (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM z) GROUP BY doc_id, g),
 q AS (SELECT doc_id, a, substr(text, a + 1, b - a) AS part, regexp_replace(substr(text, a + 1, b - a), '^[ \t\n\r\f]+', '') AS bare FROM c),
 x AS (SELECT doc_id, a + length(part) - length(bare) AS source, regexp_replace(bare, '[ \t\n\r\f]+$', '') AS piece FROM q)
"""


def _excerpts(spark, sf_dir):
    return excerpting.budgeted(table(spark, sf_dir, "documents"), "doc_id", "text", "[Hh]and", head=200, window=40, most=1000, second="\n", fill=True)


@query(_EXCERPTS + "SELECT doc_id, count(*) AS pieces, sha256(string_agg(piece, chr(10) || '[...]' || chr(10) ORDER BY source, piece)) AS digest FROM x GROUP BY 1")
def budget_excerpts(spark, sf_dir):
    own = F.filter("segments", lambda s: s["source"].isNotNull())
    e = _excerpts(spark, sf_dir)
    # a text of blanks alone is one piece without a segment
    return e.select("doc_id", F.greatest(F.size(own), F.lit(1)).cast("long").alias("pieces"), F.sha2("excerpt", 256).alias("digest"))


@query(
    _EXCERPTS
    + ", o AS (SELECT doc_id, source, length(piece) AS n, coalesce(sum(length(piece) + 7) OVER (PARTITION BY doc_id ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM x)"
    " SELECT k.doc_id, k.at, o.source + k.at - o.at AS source FROM (SELECT doc_id, unnest(range(0, 1000, 90)) AS at FROM d) k LEFT JOIN o ON k.doc_id = o.doc_id AND k.at >= o.at AND k.at < o.at + o.n"
)
def excerpt_sources(spark, sf_dir):
    asked = _excerpts(spark, sf_dir).select("doc_id", "segments", F.explode(F.sequence(F.lit(0), F.lit(999), F.lit(90))).alias("at"))
    return asked.select("doc_id", F.col("at").cast("long").alias("at"), projection.source_of(F.col("segments"), F.col("at")).cast("long").alias("source"))


_UNTIL = r"(?i)\bwaits?\s+until\s+([^;]+)"
_CONDITION_KINDS = (("amended", "(?i)amendments are"), ("referred", "(?i)referred"))
_ITEMS = r"(?i)\bitems?\s"


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'amended' WHEN 2 THEN 'referred' WHEN 3 THEN 'other' END AS kind, CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE array_to_string(range(event_id % 9 + 1, event_id % 9 + 2 + event_id % 3), ',') END END AS points FROM events"
)
def sitting_conditions(spark, sf_dir):
    i, numeral = F.col("event_id"), lambda n: text.roman_numeral(n.cast("int"))
    named = F.when(i % 5 == 0, "The sitting").when(i % 3 == 0, F.concat(F.lit("Item "), numeral(i % 9 + 1))).otherwise(F.concat(F.lit("Items "), numeral(i % 9 + 1), F.lit(" to "), numeral(i % 9 + 1 + i % 3)))
    waits = F.when(i % 4 == 0, "; see item IV.").when(i % 4 == 1, " wait until amendments are tabled;").when(i % 4 == 2, " waits until a bill is REFERRED; item X").otherwise(" wait until a chair is found")
    note = F.concat(named, waits)
    points = F.array_join(wording.conditional_items(note, _UNTIL, _ITEMS), ",")
    return table(spark, sf_dir, "events").select("event_id", wording.condition_kind(note, _UNTIL, _CONDITION_KINDS, "other").alias("kind"), points.alias("points"))


# -- parts of documents ------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, sha256(CASE WHEN p > 0 THEN array_to_string(l[p:], chr(10)) ELSE '' END) AS digest FROM (SELECT doc_id, l, list_position(list_transform(l, lambda x: NOT (trim(x, ' ') = '' OR regexp_full_match(x, '[ \t]*[-–]?[ \t]*[0-9]{1,4}[ \t]*[-–]?[ \t]*') OR trim(x, ' ') = 'Title' OR regexp_matches(trim(x, ' '), '^[A-F]'))), true) AS p FROM (SELECT doc_id, string_split('12' || chr(10) || 'Title' || chr(10) || text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
)
def bare_pages(spark, sf_dir):
    page = F.concat(F.lit("12\nTitle\n"), "text")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(sections.without_furniture(page, F.lit("Title"), "^[A-F]"), 256).alias("digest"))


_BODY_SQL = r"""WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[.] [A-Z]') THEN substr(text, length(string_split_regex(text, '[.] [A-Z]')[1]) + 1) END AS rest FROM documents)
 SELECT doc_id, length(body) AS chars, sha256(body) AS digest FROM (SELECT doc_id, substr(rest, 1, least(CASE WHEN regexp_matches(rest, '[0-9]{3}') THEN length(string_split_regex(rest, '[0-9]{3}')[1]) ELSE length(rest) END, CASE WHEN regexp_matches(rest, '[A-Z][a-z]{9}') THEN length(string_split_regex(rest, '[A-Z][a-z]{9}')[1]) ELSE length(rest) END)) AS body FROM a WHERE rest IS NOT NULL)"""


@query(_BODY_SQL)
def law_bodies(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", sections.body(F.col("text"), "[.] [A-Z]", ["[0-9]{3}", "[A-Z][a-z]{9}"]).alias("body"))
    return b.where("body IS NOT NULL").select("doc_id", F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("digest"))


_LETTER = "Enclosed is the draft. Yours, A B\n"


@query(
    "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text WHEN regexp_matches(text, '[.] [A-Z]') THEN substr(text, length(string_split_regex(text, '[.] [A-Z]')[1]) + 1) WHEN doc_id % 3 = 1 THEN chr(12) || 'next' ELSE '' END) AS digest FROM documents WHERE text IS NOT NULL"
)
def letters_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    letter = F.when(F.col("doc_id") % 3 > 0, _LETTER).otherwise("")
    page = F.when(F.col("doc_id") % 3 == 1, "\fnext").otherwise("")
    rest = sections.without_letter(F.concat(letter, "text", page), "Enclosed is the draft[.] Yours, [A-Z] [A-Z]\n", "[.] [A-Z]", 60)
    plain = F.col("doc_id") % 3 == 0
    return d.select("doc_id", F.sha2(F.when(plain, rest).otherwise(F.when(F.col("text").rlike("[.] [A-Z]"), F.regexp_replace(rest, "\fnext$", "")).otherwise(rest)), 256).alias("digest"))


@query(
    r"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[(][^()]{1,40}[)]', '', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '([0-9]+) *[-–] *([0-9]+)', '\1-\2', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '[ ]+', ' ', 'g') AS t3 FROM b),
 e AS (SELECT doc_id, 'note' AS rule, unnest(regexp_extract_all(t0, '[(][^()]{1,40}[)]')) AS found, '' AS put FROM a UNION ALL SELECT doc_id, 'range', f, regexp_replace(f, '([0-9]+) *[-–] *([0-9]+)', '\1-\2') FROM (SELECT doc_id, unnest(regexp_extract_all(t1, '([0-9]+) *[-–] *([0-9]+)')) AS f FROM b) UNION ALL SELECT doc_id, 'space', f, ' ' FROM (SELECT doc_id, unnest(regexp_extract_all(t2, '[ ]+')) AS f FROM c))
 SELECT 'all' AS rule, count(*) AS n, sum(length(t3))::BIGINT AS chars FROM c UNION ALL SELECT rule, count(*), sum(length(found))::BIGINT FROM e WHERE found <> put GROUP BY 1"""
)
def recorded_cleaning(spark, sf_dir):
    rules = [("note", "[(][^()]{1,40}[)]", ""), ("range", "([0-9]+) *[-–] *([0-9]+)", "$1-$2"), ("space", "[ ]+", " ")]
    out, kept = sections.cleaned(F.col("text"), rules)
    d = table(spark, sf_dir, "documents").select(out.alias("text"), kept.alias("kept"))
    told = d.select(F.explode(F.concat(F.array(F.struct(F.lit("all").alias("rule"), F.length("text").alias("n"))), F.transform(F.coalesce("kept", F.array()), lambda k: F.struct(k["rule"].alias("rule"), F.length(k["found"]).alias("n"))))).alias("x"))
    return told.groupBy("x.rule").agg(F.count("*").alias("n"), F.sum("x.n").alias("chars"))


@query(
    r"""WITH d AS (SELECT doc_id, text, string_split_regex(text, '[(]?[A-Z][a-z]{5,}') AS p, regexp_extract_all(text, '[(]?[A-Z][a-z]{5,}') AS h FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, i, h[i] AS head, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS st FROM (SELECT doc_id, p, h, unnest(range(1, len(h) + 1)) AS i FROM d)),
 t AS (SELECT doc_id, st, lower(replace(head, '(', '')) AS number, head[1] = '(' AS quoted, count(*) OVER (PARTITION BY doc_id, lower(replace(head, '(', ''))) AS times, min(st) OVER w AS any_next, min(st) FILTER (head[1] <> '(') OVER w AS plain_next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 u AS (SELECT doc_id, number, st, coalesce(CASE WHEN quoted THEN any_next ELSE plain_next END, length(text)) AS stop, text FROM t JOIN d USING (doc_id) WHERE times = 1)
 SELECT doc_id, number, sha256(regexp_replace(substr(text, st + 1, stop - st), '[ \t\n\r\f]+$', '')) AS digest FROM u WHERE stop - st <= 2000"""
)
def article_excerpts(spark, sf_dir):
    a = excerpting.articles(table(spark, sf_dir, "documents"), "doc_id", "text", "[(]?[A-Z][a-z]{5,}", "([A-Za-z]+)", "^[(]", 2000)
    return a.select("doc_id", "number", F.sha2("article", 256).alias("digest"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',' || event_id || ',' || event_id % 7 WHEN event_id % 3 = 1 THEN event_id || ',' || event_id % 7 ELSE '' END AS codes FROM events"
)
def codes_at_any_depth(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    deep = F.concat(F.lit('{"a":[{"code":'), i.cast("string"), F.lit(',"b":{"c":[[{"code":"'), (i % 7).cast("string"), F.lit('"}]]}}],"d":"code"}'))
    top = F.concat(F.lit('{"code":"'), kind, F.lit('","x":'), deep, F.lit("}"))
    text_ = F.when(i % 3 == 0, top).when(i % 3 == 1, deep).otherwise('{"broken":')
    e = table(spark, sf_dir, "events").select("event_id", text_.alias("body"))
    found = json_trees.named_values(e, ["event_id"], "body", "code").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("found"))
    codes = F.array_join(F.transform("found", lambda x: x["value"]), ",")
    return e.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce(codes, F.lit("")).alias("codes"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER w AS i, list_filter([event_id, CASE event_id % 4 WHEN 0 THEN lag(event_id, 2) OVER w WHEN 1 THEN lead(event_id) OVER w END], lambda x: x IS NOT NULL) AS needed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),"
    " f AS (SELECT user_id, event_id, i, 0 AS batch, needed AS held, list_sum(list_transform(needed, lambda x: 1 + x % 7))::BIGINT AS used, list_sum(list_transform(needed, lambda x: 1 + x % 7))::BIGINT AS added FROM o WHERE i = 1"
    " UNION ALL SELECT user_id, event_id, i, batch + over::INT, CASE WHEN over THEN needed ELSE list_concat(held, fresh) END, CASE WHEN over THEN 0 ELSE used END + CASE WHEN over THEN whole ELSE more END, CASE WHEN over THEN whole ELSE more END FROM (SELECT *, used + more > 20 AS over FROM"
    " (SELECT o.user_id, o.event_id, o.i, o.needed, f.batch, f.held, f.used, list_filter(o.needed, lambda x: NOT list_contains(f.held, x)) AS fresh, coalesce(list_sum(list_transform(fresh, lambda x: 1 + x % 7)), 0)::BIGINT AS more, list_sum(list_transform(o.needed, lambda x: 1 + x % 7))::BIGINT AS whole FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)))"
    " SELECT user_id, event_id, batch, added FROM f"
)
def reference_batches(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    other = F.when(F.col("event_id") % 4 == 0, F.lag("event_id", 2).over(w)).when(F.col("event_id") % 4 == 1, F.lead("event_id").over(w))
    size = lambda x: 1 + x % 7
    e = table(spark, sf_dir, "events").select("user_id", "event_id", size(F.col("event_id")).alias("size"), F.array_compact(F.array(other)).alias("ids"))
    e = e.withColumn("references", F.transform("ids", lambda x: F.struct(x.alias("id"), size(x).cast("double").alias("size"))))
    return folds.packed_with_references(e, ["user_id"], "event_id", "size", "references", 20).withColumn("added", F.col("added").cast("long"))
