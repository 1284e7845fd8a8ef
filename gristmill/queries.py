"""The library's operators as queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import dates, text
from gristmill.operators import decisions, differences, figures, folds, graphs, incremental, joins, keyed, pages, ranking, trees
from gristmill.plans import prefilter
from gristmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A small catalogue for the synthetic prose; a real one is a parameter like any other.
PATTERNS = {"hand": r"hand\w*", "stead": r"stead\w*", "tion": r"\btion\w*", "that": r"\bthat\b", "para": r"\bpar[ae]\w*"}
WEAK = ("that",)
_W = r"[\p{L}\p{N}_]"
_COUNTS = {
    "hand": r"(?i)hand[\p{L}\p{N}_]*",
    "stead": r"(?i)stead[\p{L}\p{N}_]*",
    "tion": r"(?i)(^|[^\p{L}\p{N}_])tion[\p{L}\p{N}_]*",
    "that": r"(?i)(^|[^\p{L}\p{N}_])that(?:[^\p{L}\p{N}_]|$)",
    "para": r"(?i)(^|[^\p{L}\p{N}_])par[ae][\p{L}\p{N}_]*",
}
#: A doubled separator keeps neighbouring words apart for patterns that consume it.
_SPACED = r"regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '([^\p{L}\p{N}_])', '\1\1', 'g')"
_KW = "SELECT doc_id, lang, source, " + ", ".join(f"len(regexp_extract_all({_SPACED}, '{p}'))::BIGINT AS c_{n}" for n, p in _COUNTS.items()) + " FROM documents"
_DISTINCT = " + ".join(f"(c_{n} > 0)::INT" for n in _COUNTS)
_TOTAL = " + ".join(f"c_{n}" for n in _COUNTS)
_STRONG = " OR ".join(f"c_{n} > 0" for n in _COUNTS if n not in WEAK)
_ACCEPT = f"(({_STRONG}) AND (({_DISTINCT}) >= 2 OR ({_TOTAL}) >= 3))"


@query(_KW.replace("lang, source, ", ""))
def kw_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.keyword_counts(F.col("text"), PATTERNS).alias("m"))
    return d.select("doc_id", *[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("long").alias(f"c_{n}") for n in PATTERNS])


@query(f"SELECT doc_id, {_ACCEPT} AS accepted, ({_DISTINCT})::INT AS n_hits FROM ({_KW})")
def kw_accept(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.keyword_counts(F.col("text"), PATTERNS).alias("m"))
    return d.select("doc_id", text.enough_hits(F.col("m"), WEAK).alias("accepted"), F.size("m").alias("n_hits"))


@query(f"SELECT lang, source, count(*) AS n_docs, count(*) FILTER ({_ACCEPT}) AS n_accepted, round(count(*) FILTER ({_ACCEPT}) / count(*), 6) AS accept_rate FROM ({_KW}) GROUP BY ALL")
def kw_rollup(spark, sf_dir):
    d = prefilter.prefiltered(table(spark, sf_dir, "documents").withColumn("title", F.lit(None).cast("string")), "title", "text", PATTERNS, WEAK, 0)
    return prefilter.accept_rates(d, "lang", "source")


_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query(
    f"SELECT decision, count(*) AS n FROM (SELECT CASE WHEN regexp_matches({_TITLE}, '(?i)(hand|stead)') THEN 'title' WHEN length(html) < 200 THEN 'short'"
    " WHEN regexp_matches(html, '(?i)hand') AND regexp_matches(html, '(?i)stead') OR len(regexp_extract_all(html, '(?i)hand')) + len(regexp_extract_all(html, '(?i)stead')) >= 3 THEN 'text' ELSE 'rejected' END AS decision FROM pages) GROUP BY 1"
)
def title_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", text.html_title(F.col("html")))
    return prefilter.prefiltered(p, "title", "html", {"hand": "hand", "stead": "stead"}, ("none",)).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'hand')")
def folded_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.contains_folded(F.col("text"), "HanD")).agg(F.count("*").alias("n"))


_PAGES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10)))))::INT AS page FROM documents"


@query(f"SELECT doc_id, page, length(body)::BIGINT AS n_chars FROM ({_PAGES})")
def page_split(spark, sf_dir):
    p = pages.pages_of(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return p.select("doc_id", "page", F.length("body").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, count(*) AS pages, sum(length(trim(body)))::BIGINT AS chars, sum(length(trim(body))) / count(*) < 300 AS thin FROM ({_PAGES}) GROUP BY 1")
def page_density(spark, sf_dir):
    return pages.density(pages.pages_of(table(spark, sf_dir, "documents"), "doc_id", "text", "\n"), "doc_id").select("doc_id", "pages", F.col("chars").cast("long").alias("chars"), "thin")


@query(
    f"WITH c AS (SELECT doc_id, trim(body) AS line, count(*) AS n FROM ({_PAGES}) GROUP BY 1, 2), t AS (SELECT doc_id, sum(n)::BIGINT AS rows, max(n) AS n FROM c GROUP BY 1)"
    " SELECT doc_id, t.rows, line AS majority, t.n FROM t JOIN c USING (doc_id, n) WHERE rows >= 4 AND n * 2 > rows"
)
def running_head(spark, sf_dir):
    return pages.running_heads(pages.pages_of(table(spark, sf_dir, "documents"), "doc_id", "text", "\n"), "doc_id")


@query(
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(h, '(?i)<form') THEN 'form' WHEN regexp_matches(h, '(?i)<table') THEN 'table' WHEN regexp_matches(h, '(?i)<article') THEN 'article' ELSE 'text' END AS kind FROM (SELECT substr(html, 1, 1200) AS h FROM pages)) GROUP BY 1"
)
def page_kind(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    return pages.page_kinds(p, [("form", "(?i)<form"), ("table", "(?i)<table"), ("article", "(?i)<article")]).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"SELECT doc_id, count(*) FILTER (kept)::BIGINT AS kept_pages FROM (SELECT doc_id, coalesce(last_value(CASE WHEN regexp_matches(body, '^[A-M]') THEN true WHEN regexp_matches(body, '^[N-Z]') THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING), true) AS kept FROM ({_PAGES})) GROUP BY 1"
)
def section_trim(spark, sf_dir):
    p = pages.pages_of(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    t = pages.trimmed(p, "doc_id", F.col("body").rlike("^[A-M]"), F.col("body").rlike("^[A-Z]"))
    return t.groupBy("doc_id").agg(F.count_if("kept").alias("kept_pages"))


_NORM = r"trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORM}) AS digest FROM documents")
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.digest(F.col("text")).alias("digest"))


@query(f"SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY sha256({_NORM}))")
def content_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyed.duplicates_by(d, text.digest(F.col("text")), "doc_id").select("doc_id", "first_id", "copies")


@query("SELECT source, sum(n)::BIGINT AS files, sum(n * s)::BIGINT AS bytes, count(*) AS unique_files, sum(s)::BIGINT AS unique_bytes FROM (SELECT source, text, count(*) AS n, max(strlen(text)) AS s FROM documents GROUP BY 1, 2) GROUP BY 1")
def content_census(spark, sf_dir):
    c = figures.census(table(spark, sf_dir, "documents"), ["source"], F.sha2("text", 256), F.octet_length("text"))
    return c.select("source", "files", F.col("bytes").cast("long").alias("bytes"), "unique_files", F.col("unique_bytes").cast("long").alias("unique_bytes"))


_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"""


@query(f"SELECT page_id, length({_HTML})::BIGINT AS n_chars, sha256({_HTML}) AS digest FROM pages")
def html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("SELECT page_id, array_to_string(list_distinct_in_order, ',') AS numbers FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT page_id, regexp_extract_all(url, '(\\d{2,})(?:-[A-Z])?', 1) AS l FROM pages))".replace("\\\\", "\\"))
def link_numbers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.reference_numbers(F.col("url")), ",").alias("numbers"))


@query("SELECT lang, sum(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS units FROM documents GROUP BY 1")
def utf16_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(text.utf16_length(F.col("text"))).alias("units"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), '\s+\S*\z', '') || '...' END AS clip FROM documents")
def clipped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text"), 120).alias("clip"))


# -- keyed tables ----------------------------------------------------------------


@query(
    "WITH o AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment || '!' END AS c_mktsegment, c_acctbal + 1 AS c_acctbal, c_name || '?' AS c_name FROM customer WHERE c_custkey % 2 = 0)"
    " SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL THEN o.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"
)
def upsert_coalesce(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = c.where("c_custkey % 3 <> 0")
    new = c.where("c_custkey % 2 = 0").select(
        "c_custkey", F.concat("c_name", F.lit("?")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 4 != 0, F.concat("c_mktsegment", F.lit("!"))).alias("c_mktsegment")
    )
    return keyed.upsert(old, new, ["c_custkey"], ["c_mktsegment"], ["c_name"])


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 0 AND value > 60) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def insert_if_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return keyed.insert_if_absent(e.where("event_id % 2 = 0 AND value > 60"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    return keyed.first_per_key(e, ["user_id"], [F.desc(F.date_trunc("day", "ts")), F.asc("event_id")]).select("user_id", "event_id", "value")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def key_conflicts(spark, sf_dir):
    return keyed.conflicts(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("WITH p AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey > 4), u AS (SELECT a AS k, b AS l FROM p UNION ALL SELECT b, a FROM p) SELECT n_nationkey, min(l) AS linked FROM nation LEFT JOIN u ON k = n_nationkey GROUP BY 1")
def linked_both_ways(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    links = n.where("n_nationkey > 4").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return keyed.linked_both_ways(n.select("n_nationkey"), links, "n_nationkey", "a", "b")


# -- predicates --------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice < 400000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_by_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") < 400000))
    return ranking.top(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_totalprice")


_TODAY = "2000-06-15"


@query(
    f"SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate::DATE <= DATE '{_TODAY}') OR (o_orderstatus = 'F' AND o_orderdate::DATE BETWEEN DATE '{_TODAY}' - 30 AND DATE '{_TODAY}') OR (o_orderstatus = 'P' AND o_orderdate::DATE > DATE '{_TODAY}' - 90 AND o_orderpriority = '1-URGENT')"
)
def tracked_set(spark, sf_dir):
    day, today = F.to_date("o_orderdate"), F.to_date(F.lit(_TODAY))
    status = F.col("o_orderstatus")
    closed = (status == "F") & day.between(F.date_sub(today, 30), today)
    pending = (status == "P") & (day > F.date_sub(today, 90)) & (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").where(((status == "O") & (day <= today)) | closed | pending).select("o_orderkey")


@query(f"SELECT o_orderkey, date_diff('day', DATE '{_TODAY}', o_orderdate::DATE)::INT AS days_left FROM orders WHERE o_orderdate::DATE BETWEEN DATE '{_TODAY}' AND DATE '{_TODAY}' + 7")
def due_window(spark, sf_dir):
    day, today = F.to_date("o_orderdate"), F.to_date(F.lit(_TODAY))
    # bounds on the column itself reach the scan
    near = F.col("o_orderdate").between(F.lit(_TODAY).cast("timestamp_ntz"), F.lit(_TODAY).cast("timestamp_ntz") + F.expr("INTERVAL 8 DAYS"))
    return table(spark, sf_dir, "orders").where(near & dates.within_days(day, today, 7)).select("o_orderkey", F.datediff(day, today).alias("days_left"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k') IS NOT NULL AND (props->>'$.missing') IS NULL AND (props->>'$.k')::INT >= 95")
def json_predicate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").where(k.isNotNull() & F.get_json_object("props", "$.missing").isNull() & (k >= 95))
    return e.select("event_id", k.alias("k"))


# -- joins ---------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal < 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def failing_checks(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.where("o_orderstatus = 'F'").join(c.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"))
    return ranking.top(j, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) AS discounted FROM orders")
def existence_flag(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.with_existence(table(spark, sf_dir, "orders").select("o_orderkey"), li, ["o_orderkey"], "discounted")


@query(
    "SELECT l_orderkey, arg_min(l_partkey, pos) AS first_member, min(pos)::INT AS first_pos FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size >= 25 GROUP BY 1"
)
def first_match_join(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("i")).select("l_orderkey", F.col("i.l_partkey").alias("members"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size")
    return joins.first_match(groups, "members", part, "part", F.col("p_size") >= 25, ["l_orderkey"])


@query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM (SELECT c_custkey, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * (c_custkey % 300)::INT AS since FROM customer) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= since GROUP BY 1")
def newest_not_before(spark, sf_dir):
    since = (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 300).cast("int"))).alias("since")
    c = table(spark, sf_dir, "customer").select("c_custkey", since)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return joins.newest_not_before(c, o, "c_custkey", "since", "o_orderdate", "o_orderkey").select("c_custkey", "newest")


@query(
    "WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Nation_' || s_nationkey WHEN 1 THEN 'NATION  ' || s_nationkey ELSE 'none' END AS name FROM supplier), d AS (SELECT n_nationkey, lower(n_name) AS k1, replace(lower(n_name), '_', '') AS k2 FROM nation)"
    " SELECT s_suppkey, name, coalesce(a.n_nationkey, b.n_nationkey) AS found, CASE WHEN a.n_nationkey IS NOT NULL THEN 'exact' WHEN b.n_nationkey IS NOT NULL THEN 'squashed' END AS found_by FROM n LEFT JOIN d a ON lower(name) = a.k1 LEFT JOIN d b ON regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') = b.k2".replace("\\\\", "\\")
)
def fallback_lookup(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Nation_"), "s_nationkey")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("NATION  "), "s_nationkey")).otherwise("none")
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")), table(spark, sf_dir, "nation")
    keys = [("exact", text.name_key(F.col("name")), text.name_key(F.col("n_name"))), ("squashed", text.squashed_key(F.col("name")), text.squashed_key(F.col("n_name")))]
    return joins.by_fallback_keys(s, n, "name", keys, "n_nationkey")


_PRICES = [("Brand#1", 1.0), ("Brand#2", 2.0), ("Brand#12", 5.0), ("Brand#21", 7.0)]
_PRICES_SQL = ", ".join(f"('{p}', {v})" for p, v in _PRICES)


@query(
    f"WITH t(prefix, price) AS (VALUES {_PRICES_SQL}), b AS (SELECT p_partkey, p_brand, p_size, p_type, (SELECT arg_max(price, length(prefix)) FROM t WHERE starts_with(p_brand, prefix)) AS price FROM part)"
    " SELECT p_type, CASE WHEN count(*) FILTER (price IS NULL) = 0 THEN round(sum(price * p_size * 0.5), 4) END::DOUBLE AS cost, count(*) FILTER (price IS NULL) AS unpriced FROM b GROUP BY 1"
)
def cost_by_prefix(spark, sf_dir):
    prices = spark.createDataFrame(_PRICES, "prefix string, price double")
    p = joins.by_longest_prefix(table(spark, sf_dir, "part"), "p_brand", prices, "prefix", sorted({len(x) for x, _ in _PRICES}))
    return figures.total_cost(p, [F.col("p_type")], F.col("price"), F.col("p_size"), F.lit(0.5)).withColumn("cost", F.round("cost", 4))


@query(
    "WITH a AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{6,}'))) AS x FROM documents), b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,}'))) AS x FROM benchmark), c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,}'))) AS x FROM documents)"
    " SELECT doc_id, item_id, count(*) AS shared FROM c JOIN b USING (x) GROUP BY ALL"
)
def set_overlap(spark, sf_dir):
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)).alias("names")
    d, b = table(spark, sf_dir, "documents").select("doc_id", names), table(spark, sf_dir, "benchmark").select("item_id", names)
    return joins.sharing_any(d, b, "doc_id", "names", "item_id", "names")


@query("SELECT item_id, (SELECT count(*) FROM documents d WHERE contains(d.text, b.text)) AS n_docs FROM benchmark b")
def benchmark_overlap(spark, sf_dir):
    return joins.containing(table(spark, sf_dir, "documents"), "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


# -- rollups -----------------------------------------------------------------------


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS other FROM events GROUP BY 1")
def pivot_counts(spark, sf_dir):
    t = F.col("event_type")
    conditions = {"views": t == "view", "clicks": t == "click", "purchases": t == "purchase", "other": ~t.isin("view", "click", "purchase")}
    return figures.conditional_counts(table(spark, sf_dir, "events"), [F.col("user_id")], conditions)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n, count(DISTINCT user_id) AS users, CASE WHEN count(*) FILTER (event_type = 'error' AND value < 0.05) = 0 THEN round(sum(value), 2) END::DOUBLE AS total FROM events GROUP BY 1")
def week_figures(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(~((F.col("event_type") == "error") & (F.col("value") < 0.05)), F.col("value")))
    return e.groupBy(dates.iso_week(F.to_date("ts")).alias("week")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(figures.guarded_sum(F.col("v")), 2).alias("total"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (dayofmonth(date_trunc('week', o_orderdate)::DATE + 6) <= 7) AS in_first_week FROM orders GROUP BY 1")
def month_figures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.count_if(dates.first_week_end_of_month(F.to_date("o_orderdate"))).alias("in_first_week")
    )


@query("SELECT event_type, 'k' AS entry, sum((props->>'$.k')::BIGINT)::BIGINT AS amount FROM events GROUP BY 1")
def map_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return figures.merged_maps(e, [F.col("event_type")], "m")


@query(
    "WITH p AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS s, min(ts) FILTER (event_type = 'purchase') AS e FROM events GROUP BY 1)"
    ", r AS (SELECT *, CASE WHEN s IS NULL THEN 'no start' WHEN e IS NULL THEN 'no end' WHEN e < s THEN 'reversed' END AS reason FROM p) SELECT coalesce(reason, 'known') AS state, count(*) AS n, round(avg(CASE WHEN reason IS NULL THEN (epoch_us(e) - epoch_us(s)) / 1e6 END), 3) AS mean FROM r GROUP BY 1"
)
def latency_spans_of_all(spark, sf_dir):
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(at("signup")).alias("s"), F.min(at("purchase")).alias("e"))
    span, reason = figures.span_or_reason(F.col("s"), F.col("e"), F.lit("2030-01-01").cast("timestamp_ntz"))
    return figures.coverage(p.select(span.alias("span"), reason.alias("reason")), [], "span", "reason")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) - count(DISTINCT user_id) AS repeats, count(*) FILTER (value > 90) AS over_limit FROM events GROUP BY ALL")
def traffic_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("user_id")).alias("repeats"), F.count_if(F.col("value") > 90).alias("over_limit"))


@query("SELECT strftime((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw')::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def local_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format(dates.local_day(F.col("ts"), "Europe/Warsaw"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER ((c > 1500) = (quality = 1)) AS correct FROM (SELECT doc_id, toxic, quality, lang, length(text) AS c FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def eval_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return figures.conditional_counts(d, [F.col("lang")], {"n": F.lit(True), "n_toxic": F.col("toxic") == 1, "correct": (F.length("text") > 1500) == (F.col("quality") == 1)})


# -- order ---------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END NULLS LAST, o_orderkey LIMIT 3")
def topk_highlights(spark, sf_dir):
    order = [F.desc(F.col("o_orderpriority") == "1-URGENT"), F.asc_nulls_last(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))), F.asc("o_orderkey")]
    return ranking.top(table(spark, sf_dir, "orders"), order, 3).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def result_page(spark, sf_dir):
    return ranking.top(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 30).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC, l_quantity DESC, l_partkey, l_suppkey) = 1")
def version_rank(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return ranking.best_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [flag, -F.unix_micros(F.col("l_shipdate").cast("timestamp")), -F.col("l_quantity")], ["l_partkey", "l_suppkey"])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn)::INT AS new_position FROM conversations")
def hoisted_turns(spark, sf_dir):
    return ranking.hoisted(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "system").select("conv_id", "turn", "new_position")


@query("SELECT user_id, event_type, min(event_id) AS place, arg_max(value, event_id) AS entry FROM events GROUP BY ALL")
def replaced_by_slot(spark, sf_dir):
    return ranking.replaced_by_slot(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "value")


@query("SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS released_by FROM conversations")
def held_turns(spark, sf_dir):
    return folds.held_until(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "released_by").select("conv_id", "turn", "released_by")


@query(
    "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, i, o_orderkey, x, CASE WHEN x <= 600000 THEN x ELSE 0 END AS spent, x <= 600000 AS taken FROM o WHERE i = 1"
    " UNION ALL SELECT o.o_custkey, o.i, o.o_orderkey, o.x, CASE WHEN f.spent + o.x <= 600000 THEN f.spent + o.x ELSE f.spent END, f.spent + o.x <= 600000 FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)"
    " SELECT o_custkey, o_orderkey, x AS o_totalprice FROM f WHERE taken"
)
def budget_admission(spark, sf_dir):
    return folds.admitted(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 600000.0).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, i, o_orderkey, x AS s, 1 AS n, 0 AS batch FROM o WHERE i = 1"
    " UNION ALL SELECT o.o_custkey, o.i, o.o_orderkey, CASE WHEN f.s + o.x > 700000 OR f.n >= 4 THEN o.x ELSE f.s + o.x END, CASE WHEN f.s + o.x > 700000 OR f.n >= 4 THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN f.s + o.x > 700000 OR f.n >= 4 THEN 1 ELSE 0 END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)"
    " SELECT o_custkey, o_orderkey, batch FROM f"
)
def greedy_batches(spark, sf_dir):
    return folds.packed(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 700000.0, 4).select("o_custkey", "o_orderkey", "batch")


@query(
    "WITH b AS (SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) * 2 - (event_type = 'error')::INT AS run FROM events) SELECT user_id, event_id, run::BIGINT AS run, ((row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) // 5)::BIGINT AS chunk FROM b"
)
def barrier_groups(spark, sf_dir):
    return folds.barrier_groups(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error", 5).select("user_id", "event_id", "run", "chunk")


# -- trees, phases, graphs -------------------------------------------------------------


@query("SELECT l_orderkey, string_agg(l_linenumber || '-' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS news FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND (l_orderkey, l_linenumber, l_partkey) NOT IN (SELECT (l_orderkey, l_linenumber, l_partkey) FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01') GROUP BY 1")
def tree_difference(spark, sf_dir):
    s = F.struct("l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem")
    old = F.array_sort(F.collect_list(F.when(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"), s)))
    both = li.groupBy("l_orderkey").agg(old.alias("old"), F.array_sort(F.collect_list(s)).alias("new"))
    fresh = trees.new_stages(F.col("old"), F.col("new"), ["l_linenumber", "l_partkey"])
    out = both.select("l_orderkey", F.array_join(F.transform(fresh, lambda x: F.concat_ws("-", x["l_linenumber"], x["l_partkey"])), ",").alias("news"))
    return out.where("news <> ''")


@query("SELECT n.l_orderkey, n.l_linenumber, n.l_partkey, n.d, o.d AS before FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS d FROM lineitem GROUP BY 1, 2, 3) n JOIN (SELECT l_orderkey, l_linenumber, l_partkey, min(CASE WHEN l_linenumber > 1 THEN l_linestatus END) AS d FROM lineitem GROUP BY 1, 2, 3) o USING (l_orderkey, l_linenumber, l_partkey) WHERE n.d IS DISTINCT FROM o.d")
def decision_changes(spark, sf_dir):
    li, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    new = li.groupBy(*keys).agg(F.max("l_returnflag").alias("d"))
    old = li.groupBy(*keys).agg(F.min(F.when(F.col("l_linenumber") > 1, F.col("l_linestatus"))).alias("d"))
    return trees.changed_decisions(old, new, keys, "d")


@query("WITH r AS (SELECT r_regionkey AS k, r_name FROM region) SELECT 0 AS depth, r_name AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 1, n_name, count(*) FROM nation GROUP BY ALL UNION ALL SELECT 2, s_name, count(*) FROM supplier GROUP BY ALL")
def tree_flatten(spark, sf_dir):
    # regions and nations are few and nest in a row; suppliers grow with the data and stay rows
    leaf = F.array().cast("array<struct<name:string>>").alias("children")
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), leaf)).alias("children"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.array(F.struct(F.col("r_name").alias("name"), "children")).alias("tree"))
    upper = r.select(F.explode(trees.flattened(F.col("tree"), 3)).alias("s")).select("s.depth", "s.name")
    all_ = upper.union(table(spark, sf_dir, "supplier").select(F.lit(2).alias("depth"), F.col("s_name").alias("name")))
    return all_.groupBy("depth", "name").agg(F.count("*").alias("n"))


@query("SELECT conv_id, CASE WHEN max(turn) FILTER (role = 'assistant') > coalesce(max(turn) FILTER (role = 'user'), -1) THEN 'answered' WHEN max(turn) FILTER (role = 'user') IS NOT NULL THEN 'asked' ELSE 'new' END AS state FROM conversations GROUP BY 1")
def last_state(spark, sf_dir):
    stages = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(stages.alias("stages"))
    return c.select("conv_id", trees.last_state(F.col("stages"), [("^assistant$", "answered"), ("^user$", "asked")], "new").alias("state"))


@query(
    f"WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'waiting' END AS phase, date_diff('day', o_orderdate::DATE, DATE '{_TODAY}') AS gone FROM orders)"
    " SELECT phase, count(*) AS n, count(*) FILTER (gone > CASE phase WHEN 'urgent' THEN 30 ELSE 180 END) AS stalled, max(CASE WHEN gone > CASE phase WHEN 'urgent' THEN 30 ELSE 180 END THEN gone END)::INT AS longest FROM p GROUP BY 1"
)
def stalled_phases(spark, sf_dir):
    phase = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("waiting")
    o = table(spark, sf_dir, "orders").select(phase.alias("phase"), F.to_date("o_orderdate").alias("since"))
    patience = F.when(F.col("phase") == "urgent", 30)
    return o.withColumn("stalled", dates.stalled_days(F.col("since"), F.to_date(F.lit(_TODAY)), patience)).groupBy("phase").agg(F.count("*").alias("n"), F.count("stalled").alias("stalled"), F.max("stalled").alias("longest"))


@query("SELECT strftime(CASE WHEN l.due < u.cap THEN l.due ELSE u.cap END, '%Y-%m-%d %H:%M:%S') AS release, count(*) AS n FROM (SELECT ts, ((CASE WHEN w < date_trunc('day', w) + INTERVAL 7 HOUR THEN date_trunc('day', w) ELSE date_trunc('day', w) + INTERVAL 1 DAY END + INTERVAL 7 HOUR) AT TIME ZONE 'Europe/Warsaw' AT TIME ZONE 'UTC') AS due FROM (SELECT ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw' AS w FROM events)) l, LATERAL (SELECT l.ts + INTERVAL 24 HOUR AS cap) u GROUP BY 1")
def release_schedule(spark, sf_dir):
    due = dates.next_release(F.col("ts"), "Europe/Warsaw", 7)
    return table(spark, sf_dir, "events").groupBy(F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("release")).agg(F.count("*").alias("n"))


_EDGES = "SELECT c_custkey AS a, c_custkey // 7 * 7 AS b FROM customer WHERE c_custkey % 7 <= 3 UNION ALL SELECT c_custkey, c_custkey + 7 FROM customer WHERE c_custkey % 70 = 0"


@query(f"WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, x) AS (SELECT a, a FROM w UNION SELECT r.node, w.b FROM r JOIN w ON w.a = r.x) SELECT node, min(x) AS root FROM r GROUP BY 1")
def identity_chains(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    edges = c.where("a % 7 <= 3").select("a", (F.floor(F.col("a") / 7) * 7).alias("b")).union(c.where("a % 70 = 0").select("a", F.col("a") + 7))
    return graphs.chain_roots(edges, "a", "b")


# -- ladders of rules, state between runs ----------------------------------------------------

#: Events of a user, dealt to ten lanes, stand for the stages of a process.
_LANES = "SELECT user_id, event_id % 10 AS lane, event_id, event_type AS t, value AS v FROM events"


def _lanes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", (F.col("event_id") % 10).alias("lane"), "event_id", F.col("event_type").alias("t"), F.col("value").alias("v"))


@query(
    f"WITH s AS ({_LANES}), p AS (SELECT user_id, lane"
    ", arg_max(CASE WHEN t = 'error' THEN CASE WHEN v > 90 THEN 'vetoed' WHEN v > 80 THEN 'overridden' END END, event_id) FILTER (t = 'error' AND v > 80) AS a, max(CASE WHEN t = 'error' AND v < 10 THEN 'refused' END) AS b"
    ", arg_max(CASE WHEN t = 'purchase' THEN 'passed' ELSE 'withdrawn' END, event_id) FILTER (t = 'purchase' AND v > 50 OR t = 'click' AND v < 5) AS c"
    ", bool_or(CASE WHEN t = 'signup' THEN v > 40 END) AS passed, coalesce(bool_or(t = 'signup' AND v > 20), false) AS closed FROM s GROUP BY ALL)"
    " SELECT user_id, lane, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b WHEN c = 'passed' AND closed AND passed = false THEN 'unknown' WHEN c IS NOT NULL THEN c WHEN passed THEN 'passed' WHEN closed AND passed = false THEN 'refused' WHEN closed THEN 'unknown' ELSE 'absent' END AS decision FROM p"
)
def process_decisions(spark, sf_dir):
    t, v = F.col("t"), F.col("v")
    s = _lanes(spark, sf_dir).withColumns({"passed": F.when(t == "signup", v > 40), "closed": (t == "signup") & (v > 20)})
    veto = F.when(t == "error", F.when(v > 90, "vetoed").when(v > 80, "overridden"))
    ended = F.when((t == "purchase") & (v > 50), "passed").when((t == "click") & (v < 5), "withdrawn")
    return decisions.decided(s, ["user_id", "lane"], "event_id", veto, F.when((t == "error") & (v < 10), "refused"), ended, "passed", "closed")


@query(f"SELECT user_id, lane, coalesce(max(event_id) FILTER (v > 50 AND t <> 'view') < max(event_id) FILTER (v <= 50), false) AS late FROM ({_LANES}) GROUP BY ALL")
def told_late(spark, sf_dir):
    return decisions.told_late(_lanes(spark, sf_dir), ["user_id", "lane"], "event_id", F.col("v") <= 50, F.col("t") != "view")


_ATTENTION = (
    f"SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 'important' WHEN o_orderstatus = 'F' THEN 'important' WHEN o_orderpriority = '5-LOW' THEN 'routine' ELSE 'uncertain' END AS importance"
    f", CASE WHEN date_diff('day', DATE '{_TODAY}', o_orderdate::DATE) BETWEEN 0 AND 3 THEN 'urgent' ELSE 'normal' END AS urgency"
    f", concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN 'priority' WHEN o_orderstatus = 'F' THEN 'decision' WHEN o_orderpriority = '5-LOW' THEN 'process' ELSE 'unclassified' END, CASE WHEN o_totalprice > 300000 THEN 'costly' END, CASE WHEN date_diff('day', DATE '{_TODAY}', o_orderdate::DATE) BETWEEN 0 AND 3 THEN 'near_deadline' END) AS reasons FROM orders"
)


def _attention(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    rules = [(p == "1-URGENT", "important", "priority"), (s == "F", "important", "decision"), (p == "5-LOW", "routine", "process")]
    return decisions.assessed(table(spark, sf_dir, "orders"), rules, F.to_date("o_orderdate"), F.to_date(F.lit(_TODAY)), 3, [(F.col("o_totalprice") > 300000, "costly")])


@query(f"SELECT o_orderkey, importance, urgency, reasons FROM ({_ATTENTION})")
def attention(spark, sf_dir):
    return _attention(spark, sf_dir).select("o_orderkey", "importance", "urgency", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT CASE WHEN urgency <> 'normal' OR contains(reasons, 'costly') THEN '' WHEN importance = 'routine' THEN 'routine_step' WHEN s = 'P' THEN 'no_consequence' ELSE '' END AS waits, count(*) AS n FROM ({_ATTENTION}) GROUP BY 1")
def digest_routing(spark, sf_dir):
    rules = [(F.col("importance") == "routine", "routine_step"), (F.col("o_orderstatus") == "P", "no_consequence")]
    waits = decisions.waits_because(F.col("urgency"), F.col("reasons"), ["costly"], rules)
    return _attention(spark, sf_dir).groupBy(waits.alias("waits")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '{_TODAY}') > CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 7 END AS overdue FROM orders")
def overdue_terms(spark, sf_dir):
    late = decisions.overdue(F.to_date("o_orderdate"), F.to_date(F.lit(_TODAY)), F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", late.alias("overdue"))


@query("SELECT strftime(max(ts) FILTER (event_type = 'signup' AND value > 50) - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS since FROM events")
def low_watermark(spark, sf_dir):
    ok, now = (F.col("event_type") == "signup") & (F.col("value") > 50), F.lit("2000-06-15").cast("timestamp_ntz")
    return incremental.low_watermark(table(spark, sf_dir, "events"), "ts", ok, 2, now, 30).select(F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-15' OR o_orderkey = (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01')")
def retained_runs(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    anchor = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < at("1999-01-01"))
    return incremental.retained(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", anchor, at("2000-06-15")).select("o_orderkey")


@query("SELECT status, error, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'U' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'left pending' END AS error FROM orders) GROUP BY ALL")
def outbox_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("error"))
    return incremental.swept(o, "status", "error", "left pending", "P", "U").groupBy("status", "error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 3")
def due_deliveries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("attempts", F.col("o_orderkey") % 5)
    return incremental.due_again(o, "o_orderstatus", "attempts", 3, "F").select("o_orderkey")


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS k, o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS d FROM orders WHERE o_orderkey % 7 <> 0)"
    " SELECT k AS o_orderkey, strftime(o.d, '%Y-%m-%d') AS was, strftime(n.d, '%Y-%m-%d') AS day, CASE WHEN o.d IS NULL THEN 'new' WHEN n.d IS NULL THEN 'cancelled' ELSE 'moved' END AS state FROM o FULL JOIN n USING (k) WHERE o.d IS DISTINCT FROM n.d"
)
def schedule_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    new = o.where("o_orderkey % 7 <> 0").withColumn("day", F.date_add("day", F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(0)))
    got = incremental.schedule_changes(o.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"], "day")
    return got.select("o_orderkey", F.date_format("was", "yyyy-MM-dd").alias("was"), F.date_format("day", "yyyy-MM-dd").alias("day"), "state")


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + floor(l_quantity / 3)::BIGINT AS e FROM lineitem), g AS (SELECT *, s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM r)"
    ", i AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g), m AS (SELECT l_orderkey, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)"
    " SELECT l_orderkey, bool_or(s <= 12 AND 25 <= e) AS covered FROM m GROUP BY 1"
)
def covered_ranges(spark, sf_dir):
    start = (F.col("l_linenumber") * 10).cast("long")
    one = F.struct(start.alias("start"), (start + F.floor(F.col("l_quantity") / 3)).alias("end"))
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("r"))
    need = F.array(F.struct(F.lit(12).cast("long").alias("start"), F.lit(25).cast("long").alias("end")))
    return r.select("l_orderkey", incremental.ranges_cover(F.col("r"), need).alias("covered"))


@query(
    "SELECT source, 'number' AS kind, count(DISTINCT x) AS n_values FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9]{6,}')) AS x FROM documents) GROUP BY 1"
    " UNION ALL SELECT source, 'name', count(DISTINCT x) FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS x FROM documents) GROUP BY 1"
)
def bundle_facts(spark, sf_dir):
    return pages.facts(table(spark, sf_dir, "documents"), ["source"], "text", {"number": "[0-9]{6,}", "name": "[A-Z][a-z]{7,}"}).groupBy("source", "kind").agg(F.count_distinct("value").alias("n_values"))


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def worded_dates(spark, sf_dir):
    told = F.concat(F.lit("of "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", item 3"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.worded_date(told, MONTHS), "yyyy-MM-dd").alias("day"))


@query(f"SELECT doc_id, sha256({_NORM.replace('text', chr(39).join(['translate(text, ', '„“”‘’‐‑‒–—' + chr(0xAD), ', ', chr(34) * 3 + chr(39) * 4 + '-----', ')']))}) AS digest FROM documents")
def typographic_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.typographic(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) <= 207 THEN text ELSE substr(text, 1, 150) || ' [...] ' || right(text, 50) END AS told FROM documents")
def budget_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.within_budget(F.col("text"), 207).alias("told"))


# -- texts that SQL can't follow: compared with plain Python in the tests ------------------


@query()
def markup_parts(spark, sf_dir):
    # paragraphs of a text as message markup
    html = F.concat(F.lit("<b>"), F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), "\n", "</b>\n<b>"), F.lit("</b>"))
    return pages.markup_parts(table(spark, sf_dir, "documents").select("doc_id", html.alias("html")), "doc_id", "html")


@query()
def message_part_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return pages.message_parts(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.length("body")).cast("long").alias("longest"))


@query()
def message_parts(spark, sf_dir):
    return pages.message_parts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH d AS (SELECT doc_id, length(text) AS size, string_split_regex(text, '(?i)hand') AS p FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, size, (list_sum(list_transform(p[1:i], lambda x: length(x))) + 4 * (i - 1))::INT AS st FROM (SELECT *, unnest(range(1, len(p))) AS i FROM d)),
 w AS (SELECT doc_id, greatest(st - 80, 0)::INT AS a, least(st + 84, size)::INT AS b FROM s),
 f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w),
 g AS (SELECT doc_id, n, min(a) AS start, max(b) AS stop FROM (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INT AS n FROM f) GROUP BY 1, 2)
 SELECT doc_id, n, start, stop AS "end", substr(text, start + 1, stop - start) AS excerpt FROM g JOIN documents USING (doc_id)"""
)
def keyword_excerpts(spark, sf_dir):
    return pages.excerpts(table(spark, sf_dir, "documents"), "doc_id", "text", "hand")


@query()
def text_changes(spark, sf_dir):
    # neighbours by id under one title, a text's first line: versions of one text
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.substring_index("text", "\n", 1)).alias("title"))
    told = differences.successive(d, "title", "doc_id", "text", "old_id")
    share = F.when(F.col("words") > 0, F.round(F.col("changed") / F.col("words"), 6)).otherwise(1.0)
    return told.select("doc_id", "old_id", F.col("changed").alias("changed_words"), share.alias("changed_share"))
