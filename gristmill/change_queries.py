"""Queries over trees in JSON, versions of texts, listing pages and merged sources, each with SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import dates, json, letters, text, wording
from gristmill.operators import alignment, decisions, differences, figures, inspection, json_trees, keyed, machines, markup, merging, pages, records, selection, sittings, splits, versions
from gristmill.operators.graphs import shared_folder
from gristmill.sources import paged
from gristmill.sources.tables import table
from gristmill.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# -- trees in JSON -------------------------------------------------------------------

#: A process an event: a stage of one to ten levels, each with a closing stage beside the next one, then a last stage; some texts are broken, empty or of another shape.
_PROCESS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{"stages":[' WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '{"stages":{"a":1}}' ELSE '{"number":"' || event_id || '","stages":[' ||
 list_reduce(list_prepend('', list_transform(range(event_id % 10 + 1, 0, -1), lambda k: k::VARCHAR)), lambda made, k: '{"stageName":"' || event_type || k || '","sittingNum":' || k || ',"children":[' || made || CASE WHEN made <> '' THEN ',' ELSE '' END || '{"stageName":"end' || k || '"}]}') ||
 ',{"stageName":"last","sittingNum":"x"}]}' END AS j FROM events"""


def _processes(spark, sf_dir):
    nested = F.aggregate(
        F.sequence((F.col("event_id") % 10 + 1).cast("int"), F.lit(1), F.lit(-1)), F.lit(""),
        lambda made, k: F.concat(F.lit('{"stageName":"'), F.col("event_type"), k.cast("string"), F.lit('","sittingNum":'), k.cast("string"), F.lit(',"children":['), made, F.when(made != "", ",").otherwise(""), F.lit('{"stageName":"end'), k.cast("string"), F.lit('"}]}')),
    )
    i = F.col("event_id")
    whole = F.concat(F.lit('{"number":"'), i.cast("string"), F.lit('","stages":['), nested, F.lit(',{"stageName":"last","sittingNum":"x"}]}'))
    text = F.when(i % 11 == 0, '{"stages":[').when(i % 13 == 0, "").when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, '{"stages":{"a":1}}').otherwise(whole)
    # a text is many times its row, so the rows are dealt out before, evenly and to as many tasks as the session sets
    dealt = table(spark, sf_dir, "events").select("event_id", "event_type").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return dealt.select("event_id", text.alias("process"))


@query(
    f"""WITH RECURSIVE t AS ({_PROCESS}), n AS (
 SELECT event_id, [i]::BIGINT[] AS path, json_extract(j, '$.stages[' || i || ']') AS node FROM (SELECT event_id, j, unnest(range(json_array_length(j, '$.stages')::BIGINT)) AS i FROM t WHERE json_valid(j))
 UNION ALL SELECT event_id, list_append(path, i), json_extract(node, '$.children[' || i || ']') FROM (SELECT *, unnest(range(json_array_length(node, '$.children')::BIGINT)) AS i FROM n WHERE json_type(node, '$.children') = 'ARRAY'))
 SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY path) - 1)::INT AS place, (len(path) - 1)::INT AS depth, node->>'$.stageName' AS name, TRY_CAST(node->>'$.sittingNum' AS INT) AS sitting FROM n"""
)
def json_stages(spark, sf_dir):
    fields = {"name": ("$.stageName", "string"), "sitting": ("$.sittingNum", "int")}
    return json_trees.tree_places(_processes(spark, sf_dir), ["event_id"], "process", "$.stages", "$.children", fields)


@query(
    "WITH o AS (SELECT o_custkey AS c, sha256(string_agg(sha256('=' || o_orderstatus || chr(30)), '' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1)"
    ", c AS (SELECT c_nationkey AS n, sha256(string_agg(sha256('=' || c_mktsegment || chr(30) || coalesce(d, '')), '' ORDER BY c_custkey)) AS d FROM customer LEFT JOIN o ON c = c_custkey GROUP BY 1)"
    " SELECT n_nationkey AS process, sha256(sha256('=' || n_name || chr(30) || coalesce(d, ''))) AS fingerprint FROM nation LEFT JOIN c ON n = n_nationkey"
)
def tree_fingerprints(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    path = lambda *x: F.array(F.lit(0).cast("long"), *x).alias("path")
    deep = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        n.select(F.col("n_nationkey").alias("process"), F.col("n_name").alias("name"), path())
        .union(c.select("c_nationkey", "c_mktsegment", path("c_custkey")))
        .union(deep.select("c_nationkey", "o_orderstatus", path("c_custkey", "o_orderkey")))
    )
    return json_trees.tree_prints(rows, ["process"], [F.col("name")])


# -- versions of texts ---------------------------------------------------------------

#: The next version of a document: the same, spaced and cased otherwise, one sentence more, or its first half.
_VERSIONS = r"""SELECT doc_id, text AS a, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN translate(replace(text, ' ', chr(10) || ' '), 'aeiost', 'AEIOST') WHEN 2 THEN text || ' Three words more.' WHEN 3 THEN substr(text, 1, length(text) // 2) END AS b FROM documents"""
_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _versions(spark, sf_dir):
    i, t = F.col("doc_id") % 5, F.col("text")
    new = F.when(i == 0, t).when(i == 1, F.translate(F.replace(t, F.lit(" "), F.lit("\n ")), "aeiost", "AEIOST")).when(i == 2, F.concat(t, F.lit(" Three words more."))).when(i == 3, F.substr(t, F.lit(1), F.floor(F.length(t) / 2).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("old"), new.alias("new"))


@query(
    f"""WITH v AS ({_VERSIONS}), w AS (SELECT *, {_W.format('a')} AS x, {_W.format('b')} AS y, least(length(regexp_replace(coalesce(a, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')), length(regexp_replace(coalesce(b, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS n FROM v)
 , c AS (SELECT doc_id, n, a, b, len(x) AS words, CASE doc_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE len(x) - len(y) + (NOT list_contains(x[len(y):], y[len(y)]))::INT END AS changed, CASE WHEN doc_id % 5 = 2 THEN len(y) ELSE len(x) END AS most FROM w)
 SELECT doc_id, CASE WHEN n < 100 THEN 'nothing' WHEN a = b THEN 'equal' WHEN changed = 0 THEN 'noise' WHEN changed <= 0.05 * most THEN 'review' ELSE 'large' END AS band, CASE WHEN n >= 100 AND a <> b THEN changed::BIGINT END AS changed FROM c"""
)
def difference_bands(spark, sf_dir):
    return differences.bands(_versions(spark, sf_dir), ["doc_id"], "old", "new", 0.05, 100).select("doc_id", "band", "changed")


#: Lines of an order as a table, and as running text: the value stands behind the line's number or last, some parts are worded otherwise, and every fourth order's text runs backwards.
_TABLES = """SELECT o, string_agg('Line ' || n || chr(9) || 'part ' || p || chr(9) || 'flag ' || f || chr(9) || q, chr(10) ORDER BY n) AS a,
 string_agg(CASE WHEN n % 2 = 0 THEN 'LINE ' || n || ' ' || q || ', part ' || p || CASE WHEN p % 7 = 0 THEN ' now' ELSE '' END || ' flag ' || f ELSE 'Line ' || n || ' part ' || p || CASE WHEN p % 7 = 0 THEN ' now' ELSE '' END || ' flag ' || f || ' ' || q END, '. ' ORDER BY CASE WHEN o % 4 = 0 THEN -n ELSE n END) AS b
 FROM (SELECT l_orderkey AS o, l_partkey AS p, l_returnflag AS f, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) GROUP BY o"""


@query(
    "WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_returnflag AS f, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)"
    ", k AS (SELECT *, min(n) OVER (PARTITION BY o) AS first FROM l WHERE p % 7 <> 0)"
    " SELECT o AS l_orderkey, (n - 1)::INT AS line, CASE WHEN n % 2 = 0 THEN 'LINE ' || n || ' ' || q || ', part ' || p || ' flag ' || f ELSE 'Line ' || n || ' part ' || p || ' flag ' || f || ' ' || q END AS found FROM k WHERE o % 4 <> 0 OR n = first"
)
def aligned_lines(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("int").alias("q"), F.row_number().over(w).alias("n"))
    say = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    n, p, f, q = (F.col(c) for c in "npfq")
    now = F.when(p % 7 == 0, " now").otherwise("")
    told = F.when(n % 2 == 0, say("LINE ", n, " ", q, ", part ", p, now, " flag ", f)).otherwise(say("Line ", n, " part ", p, now, " flag ", f, " ", q))
    order = F.when(F.col("l_orderkey") % 4 == 0, -n).otherwise(n)
    listed = lambda by, text, gap: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("by"), text.alias("text")))), lambda x: x["text"]), gap)
    texts = li.groupBy("l_orderkey").agg(listed(n, say("Line ", n, "\t", "part ", p, "\t", "flag ", f, "\t", q), "\n").alias("old"), listed(order, told, ". ").alias("new"))
    return alignment.aligned(texts, ["l_orderkey"], "old", "new").select("l_orderkey", "line", "found").withColumn("line", F.col("line").cast("int"))


# -- sections of long documents -------------------------------------------------------

_SECTIONS = ("body", "notes", "table", "rest", "annex", "drafts", "late annex")
#: From each section, where a page of a kind leads: behind the table no body is opened again, and the drafts never end.
_MOVES = {"body": (0, 0, 2, 3, 0, 5, 6), "notes": (1, 1, 2, 3, 1, 5, 6), "table": (2, 2, 2, 2, 2, 5, 2), "annex": (4, 4, 6, 6, 4, 5, 6), "drafts": (5, 5, 5, 5, 5, 5, 5)}
_KINDS = (("body", "^[A-C]"), ("notes", "^[D-F]"), ("table", "^[G-I]"), ("annex", "^[J-M]"), ("drafts", "^[XYZ]"))
_LINES = "SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH RECURSIVE k AS (SELECT doc_id, i, l[i] AS body, CASE {' '.join(f"WHEN regexp_matches(l[i], '{p}') THEN {n}" for n, (_, p) in enumerate(_KINDS, 1))} END AS kind, strpos(l[i], ' the ') AS cut FROM ({_LINES})),
 m(kind, moves) AS (VALUES {', '.join(f'({n}, {list(_MOVES[k])})' for n, (k, _) in enumerate(_KINDS, 1))}),
 s AS (SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS body, 0 AS here, 0 AS after, 0::BIGINT AS cut FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT doc_id, i, body, here, CASE WHEN here = 2 AND cut > 0 THEN 3 ELSE here END, CASE WHEN here = 2 THEN cut ELSE 0 END FROM (SELECT k.doc_id, k.i, k.body, coalesce(m.moves[s.after + 1], s.after) AS here, k.cut FROM s JOIN k ON k.doc_id = s.doc_id AND k.i = s.i + 1 LEFT JOIN m ON m.kind = k.kind)),
 p AS (SELECT doc_id, i, 0 AS half, CASE WHEN here < 3 THEN NULL ELSE {list(_SECTIONS)}[here + 1] END AS name, CASE WHEN here < 3 THEN CASE WHEN cut > 0 THEN rtrim(body[:cut - 1]) ELSE body END ELSE '' END AS text, CASE WHEN here < 3 THEN 0 ELSE length(body) END AS chars FROM s WHERE i > 0
  UNION ALL SELECT doc_id, i, 1, 'rest', '', length(body) - cut + 1 FROM s WHERE i > 0 AND cut > 0),
 r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i, half) AS run FROM (SELECT *, CASE WHEN name IS NOT NULL AND name IS NOT DISTINCT FROM lag(name) OVER (PARTITION BY doc_id ORDER BY i, half) THEN 0 ELSE 1 END AS new FROM p)),
 g AS (SELECT doc_id, run, CASE WHEN max(name) IS NULL THEN any_value(text) ELSE chr(10) || '[left out: ' || max(name) || ', ' || sum(chars) || ' characters]' || chr(10) END AS text, CASE WHEN max(name) IS NOT NULL THEN sum(chars) ELSE 0 END AS chars, max(name) IS NULL AND max(text) <> '' AS kept FROM r GROUP BY doc_id, run)
 SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY run)) AS digest, sum(chars)::BIGINT AS left_out, count(*) FILTER (kept) AS segments FROM g GROUP BY 1"""
)
def machine_sections(spark, sf_dir):
    d = pages.pages_of(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", "\n")
    kind = F.coalesce(*[F.when(F.col("body").rlike(p), F.lit(k)) for k, p in _KINDS])
    t = machines.trimmed(d, ["doc_id"], "page", "body", kind, _MOVES, _SECTIONS, ("rest", "annex", "drafts", "late annex"), {"table": (" the ", "rest")}, "\n")
    return t.select("doc_id", F.sha2("text", 256).alias("digest"), "left_out", F.size("segments").cast("long").alias("segments"))


# -- listing pages -----------------------------------------------------------------------


@query(
    r"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::BIGINT AS item, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>([^<]*)</a>', 1) AS text
 FROM (SELECT page_id, l[i] AS x, i FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>') AS l FROM pages)))"""
)
def page_links(spark, sf_dir):
    c = markup.cells(table(spark, sf_dir, "pages"), ["page_id"], "html", "ul", "li", ("a",))
    # the link is the cell's own tag
    return c.select("page_id", F.col("row").cast("long").alias("item"), "href", "text")


@query(
    "WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"
    " SELECT o_custkey, n AS row, o_orderkey AS id, 'R&D „' || o_orderstatus || '“ §' || n AS title, CASE WHEN n % 3 = 0 THEN 'inner ' || o_orderkey END AS inside FROM c"
)
def listing_rows(spark, sf_dir):
    """Each customer's orders as a listing page, with unclosed cells and rows, entities and a table in some cells, read again."""
    n, key = F.col("n"), F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    title = F.concat(F.lit("R&amp;D &bdquo;"), "o_orderstatus", F.lit("&#8220; &#xA7;"), n.cast("string"))
    nested = F.when(n % 3 == 0, F.concat(F.lit("<table><tr><td>inner "), key, F.lit("</table>"))).otherwise("")
    closed = lambda tag: F.when(n % 2 == 0, F.lit(tag)).otherwise("")
    line = F.concat(F.lit('\n<TR class=row><td><a title="x" href="/order/'), key, F.lit('">'), title, F.lit("</a>"), closed("</td>"), F.lit("<td><!-- <td>no</td> -->"), nested, closed("</td></tr>"))
    html = F.concat(F.lit("<html><script>var t='<table><tr><td>';</script></table><table id=t>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))), lambda x: x["x"]), ""), F.lit("</table><p>end"))
    cells = markup.cells(o.groupBy("o_custkey").agg(html.alias("html")), ["o_custkey"], "html")
    outer = cells.where("parent is null and cell = 1").select("o_custkey", "row", F.regexp_extract("href", "([0-9]+)$", 1).cast("long").alias("id"), F.col("text").alias("title"))
    inner = cells.where("parent is not null").select("o_custkey", F.regexp_extract("text", "([0-9]+)$", 1).cast("long").alias("id"), F.col("text").alias("inside"))
    return outer.join(inner, ["o_custkey", "id"], "left").select("o_custkey", F.col("row").cast("long").alias("row"), "id", "title", "inside")


# -- versions and sources --------------------------------------------------------------------


@query(
    "WITH d AS (SELECT doc_id, doc_id // 4 AS g FROM documents), m AS (SELECT g, count(*) AS members, count(*) FILTER (g % 3 = 0 AND doc_id % 4 = 2) AS odd, count(*) FILTER (doc_id % 4 <> 2) AS plain, max(doc_id % 4) AS last FROM d GROUP BY g)"
    " SELECT g, members, CASE WHEN g % 2 = 0 THEN 1 ELSE members END AS considered, CASE WHEN g % 2 = 0 THEN 1::BIGINT ELSE (odd > 0)::BIGINT + (members - odd > 0)::BIGINT END AS identities, g % 2 = 0 OR odd = 0 OR odd = members AS same, g % 2 = 0 AND members > 1 AS by_date FROM m"
)
def version_identities(spark, sf_dir):
    """Four documents a group are versions of its first text: a note in brackets, as a numbered line, changed or plain again; even groups are dated."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 4).cast("long").alias("g"), (F.col("doc_id") % 4).alias("k"))
    first = d.groupBy("g").agg(F.min_by(F.coalesce("text", F.lit("")), "doc_id").alias("base"))
    say = "See the annex of this act for every rate that applies."
    v = d.join(first, "g").withColumn("base", F.regexp_replace("base", r"[()0-9]", ""))
    text = F.when(F.col("k") == 1, F.concat("base", F.lit("\n word1), end.\n 1) "), F.lit(say.upper()), F.lit("\n"))).when((F.col("k") == 2) & (F.col("g") % 3 == 0), F.concat("base", F.lit(" word (note: Another one.) end."))).otherwise(F.concat("base", F.lit(f" word (note: {say}) end.")))
    made = F.when((F.col("g") % 2 == 0) | (F.col("k") == 0), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")))
    made = F.when((F.col("g") % 2 == 1), F.lit(None).cast("date")).otherwise(made)
    return versions.compared(v.withColumn("text", text), ["g"], "doc_id", "text", F.lit("act"), made).select("g", "members", "considered", "identities", "same", "by_date")


#: Texts that fail at one step each, or at none.
_RESOLVED = (
    ("none", "no_heading", "''"), ("two", "several_headings", "'RESOLUTION x RESOLUTION of 2024-01-02 on y. Whereas z, adopts 3 changes. Signed'"), ("undated", "no_date", "'RESOLUTION on y. Whereas'"),
    ("bad day", "bad_date", "'RESOLUTION of 2024-13-45 on y. Whereas z, adopts 3 changes. Signed'"), ("no subject", "no_subject", "'RESOLUTION of 2024-01-02. Whereas z'"), ("no end", "no_outcome", "'RESOLUTION of 2024-01-02 on rates. Whereas the end'"),
    ("unsigned", "unsigned", "'RESOLUTION of 2024-01-02 on rates. Whereas so, adopts 2 changes.'"), ("early", "too_early", "'RESOLUTION of 1999-01-02 on rates. Whereas so, adopts 2 changes. Signed'"), ("fine", "", "'RESOLUTION of 2024-01-02 on rates. Whereas so, adopts 2 changes. Signed'"),
)


@query(
    f"SELECT event_id, CASE event_id % 9 {' '.join(f"WHEN {i} THEN '{limit}'" for i, (_, limit, _) in enumerate(_RESOLVED))} END AS limitation, CASE WHEN event_id % 9 > 4 THEN 'rates' END AS subject, CASE event_id % 9 WHEN 4 THEN DATE '2024-01-02' WHEN 5 THEN DATE '2024-01-02' WHEN 6 THEN DATE '2024-01-02' WHEN 7 THEN DATE '1999-01-02' WHEN 8 THEN DATE '2024-01-02' END AS adopted, CASE WHEN event_id % 9 > 5 THEN 2 END AS changes FROM events"
)
def inspected_texts(spark, sf_dir):
    text = F.lit(None).cast("string")
    for i, (_, _, words) in enumerate(_RESOLVED):
        text = F.when(F.col("event_id") % len(_RESOLVED) == i, F.lit(words.strip("'"))).otherwise(text)
    anchors = [
        inspection.Anchor("heading", "RESOLUTION", "no_heading", several="several_headings"),
        inspection.Anchor("adopted", r"\s+of\s+([0-9-]+)", "no_date", kind="date", invalid="bad_date", next=True),
        inspection.Anchor("subject", r"\s+on\s+([^.]+)\.", "no_subject", next=True),
        inspection.Anchor("changes", r"adopts\s+(\d+)\s+changes\.", "no_outcome", kind="int"),
        inspection.Anchor("signature", "Signed", "unsigned"),
    ]
    rules = [("too_early", F.col("adopted") < F.lit("2000-01-01").cast("date"))]
    e = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return inspection.inspected(e, "text", anchors, rules).select("event_id", "limitation", "subject", "adopted", "changes")


@query(
    "WITH c AS (SELECT c_custkey AS k, c_name, c_nationkey, min(o_orderkey) AS o1, min(o_orderpriority) FILTER (o_orderkey IS NOT NULL) AS p, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)"
    ", m AS (SELECT k, n, s_suppkey, c_name, c_nationkey, s_name, s_nationkey, p FROM c LEFT JOIN supplier ON s_suppkey = k AND k % 3 = 0)"
    " SELECT 'customer:' || k AS identity, 1 + n + (s_suppkey IS NOT NULL)::INT AS records, c_name AS name, coalesce(s_nationkey, c_nationkey)::BIGINT AS nation, p AS priority, array_to_string(list_filter([CASE WHEN s_name <> c_name THEN 'name' END, CASE WHEN s_nationkey <> c_nationkey THEN 'nation' END, CASE WHEN (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = k) > 1 THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM m"
    " UNION ALL SELECT 'supplier:' || s_suppkey, 1, s_name, s_nationkey, NULL, '' FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey NOT IN (SELECT c_custkey FROM customer)"
)
def merged_sources(spark, sf_dir):
    """Suppliers continue customers and orders continue either: names from customers, nations from suppliers, priorities from orders."""
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = (
        c.select(merging.node("customer", F.col("c_custkey")).alias("node"), F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), none("string", "priority"))
        .union(s.select(merging.node("supplier", F.col("s_suppkey")), F.lit("supplier"), "s_name", F.col("s_nationkey").cast("long"), none("string", "priority")))
        .union(o.select(merging.node("order", F.col("o_orderkey")), F.lit("order"), none("string", "name"), none("long", "nation"), "o_orderpriority"))
    )
    links = s.where("s_suppkey % 3 = 0").select(merging.node("supplier", F.col("s_suppkey")).alias("left"), merging.node("customer", F.col("s_suppkey")).alias("right"))
    # an order of every third customer is known through the supplier: two hops
    through = F.when((F.col("o_custkey") % 3 == 0) & F.col("s_suppkey").isNotNull(), merging.node("supplier", F.col("o_custkey"))).otherwise(merging.node("customer", F.col("o_custkey")))
    links = links.union(o.join(s.select("s_suppkey"), F.col("o_custkey") == F.col("s_suppkey"), "left").select(merging.node("order", F.col("o_orderkey")), through))
    rank = {"name": ("customer", "supplier"), "nation": ("supplier", "customer"), "priority": ("order",)}
    found = merging.survived(merging.identified(rows, links), ["name", "nation", "priority"], rank)
    return found.select("identity", "records", "name", "nation", "priority", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    "WITH k AS (SELECT c_custkey, c_name, c_nationkey, 'x' || c_custkey AS other FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_name, min(c_custkey) AS k3 FROM k GROUP BY 1 HAVING count(*) = 1)"
    ", r AS (SELECT c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN c_custkey % 12 = 0 THEN c_name ELSE 'new ' || c_name END AS name, CASE WHEN c_custkey % 9 = 6 THEN 'x' || c_custkey END AS other, c_mktsegment AS seg, c_acctbal AS bal FROM customer)"
    " SELECT id, CASE WHEN a.c_custkey IS NOT NULL THEN 'known' WHEN b.c_custkey IS NOT NULL THEN 'linked' WHEN k3 IS NOT NULL THEN 'renumbered' WHEN seg = 'BUILDING' THEN 'irrelevant' WHEN bal < 0 THEN 'skipped' ELSE 'new' END AS state, coalesce(a.c_custkey, b.c_custkey, k3) AS linked FROM r LEFT JOIN k a ON a.c_custkey = id LEFT JOIN k b ON b.other = r.other LEFT JOIN n ON n.c_name = r.name"
)
def discovery_cascade(spark, sf_dir):
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    known = c.where("c_custkey % 3 = 0").select("c_custkey", "c_name", F.concat(F.lit("x"), i.cast("string")).alias("other"))
    listed = c.select(
        (i + F.when(i % 6 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.when(i % 12 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new "), "c_name")).alias("name"),
        F.when(i % 9 == 6, F.concat(F.lit("x"), i.cast("string"))).alias("other"), "c_mktsegment", "c_acctbal",
    )
    met = merging.cascade(listed, known, "c_custkey", F.col("name"), F.col("c_name"), "other", "other", F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") >= 0)
    return met.select(F.col("c_custkey").alias("id"), "state", "linked")


_SHARES = (("tuning", 1.0), ("holdout", 2.0))
_GROUPS = """WITH RECURSIVE v AS (SELECT doc_id, 't' || sha256(text) AS v FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'f' || coalesce(regexp_extract(text, '^[^\\n]*'), '') FROM documents WHERE text IS NOT NULL),
 e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY v) AS b FROM v), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c), g AS (SELECT d AS doc_id, min(c) AS root FROM r GROUP BY 1),
 z AS (SELECT root, n, row_number() OVER (ORDER BY n DESC, root) AS i FROM (SELECT root, count(*) AS n FROM g GROUP BY 1)),
 f AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS s, 0::BIGINT AS n UNION ALL SELECT z.i, a + CASE WHEN a <= b / 2 THEN z.n ELSE 0 END, b + CASE WHEN a <= b / 2 THEN 0 ELSE z.n END, CASE WHEN a <= b / 2 THEN 0 ELSE 1 END, z.n FROM f JOIN z ON z.i = f.i + 1),
 t AS (SELECT n, count(*) FILTER (s = 0) AS first FROM f WHERE i > 0 GROUP BY n), w AS (SELECT root, z.n, row_number() OVER (PARTITION BY z.n ORDER BY root) AS k FROM z)""".replace("\\\\n", "\\n")


def _split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("whole"), F.regexp_extract("text", r"^[^\n]*", 0).alias("first"))
    return splits.split(splits.grouped(d, "doc_id", [F.col("whole"), F.col("first")]), "doc_id", "root", _SHARES)


@query(f"{_GROUPS} SELECT doc_id, g.root, CASE WHEN k <= first THEN 'tuning' ELSE 'holdout' END AS split FROM g JOIN w ON w.root = g.root JOIN t ON t.n = w.n")
def safe_splits(spark, sf_dir):
    return _split(spark, sf_dir)


@query("SELECT 'group' AS kind, 0 AS leaking, count(*) AS rows FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(*) FROM documents WHERE source IS NOT NULL")
def split_leaks(spark, sf_dir):
    """The proof: no group stands in two splits, while every source does."""
    s = _split(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    count = lambda kind, c: splits.leaks(s, [c], "split").agg(F.lit(kind).alias("kind"), F.count("*").alias("leaking"))
    rows = s.agg(F.lit("group").alias("kind"), F.count("*").alias("rows")).union(s.where("source is not null").agg(F.lit("source"), F.count("*")))
    return count("group", "root").union(count("source", "source")).join(rows, "kind")


# -- captured listings, changes -----------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= DATE '1997-03-01' AND o_orderdate::DATE < DATE '1998-02-01' AND o_orderstatus <> 'P'")
def paged_orders(spark, sf_dir):
    """Orders captured as a listing, newest first; bounds on the day choose the pages that are read."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    where = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    paged.capture(o, "day", "o_orderkey", where, 500)
    day = F.col("day")
    found = paged.read_pages(spark, where, "o_orderkey long, o_custkey long, o_orderstatus string, day date", "day", day >= F.lit("1997-03-01").cast("date"), day < F.lit("1998-02-01").cast("date"), F.col("o_orderstatus") != "P")
    return found.select("o_orderkey", "o_custkey", "day")


@query(
    "WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS millis, event_type AS kind FROM events), l AS (SELECT *, lag(kind) OVER w AS was, lag(millis) OVER w AS last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY millis, kind))"
    " SELECT user_id, millis, was, kind FROM l WHERE was <> kind AND millis - last <= 172800000"
)
def state_changes(spark, sf_dir):
    """The batch answer that the change stream gives too: a user is forgotten after two silent days."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = changes.changes_of(e, "user_id", "ts", "event_type", 2 * 86_400)
    return found.select(F.col("key").cast("long").alias("user_id"), F.unix_millis("at").alias("millis"), F.col("before").alias("was"), F.col("now").alias("kind"))


# -- records in JSON --------------------------------------------------------------------------------


_VOTE = "CASE WHEN value > 75 THEN 'YES' WHEN value > 50 THEN 'NO' WHEN value > 30 THEN 'ABSTAIN' WHEN value > 20 THEN 'ABSENT' ELSE 'OTHER' END"


@query(
    f"SELECT event_id // 40 AS voting, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS club, count(*) FILTER (v = 'YES') AS yes, count(*) FILTER (v = 'NO') AS no, count(*) FILTER (v = 'ABSTAIN') AS abstain, count(*) FILTER (v NOT IN ('YES', 'NO', 'ABSTAIN')) AS absent, 'https://votes/' || event_id // 40 || '.pdf' AS pdf FROM (SELECT *, {_VOTE} AS v FROM events) GROUP BY ALL"
)
def votes_by_club(spark, sf_dir):
    """Votings as JSON records with their votes and links, read by a fixed schema and counted by club; a blank club is one."""
    e = table(spark, sf_dir, "events").withColumn("voting", F.floor(F.col("event_id") / 40).cast("long"))
    vote = F.struct(F.col("user_id").alias("MP"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("club"), F.expr(_VOTE).alias("vote"))
    link = lambda rel, end: F.struct(F.lit(rel).alias("rel"), F.concat(F.lit("https://votes/"), F.col("voting").cast("string"), F.lit(end)).alias("href"))
    texts = e.groupBy("voting").agg(F.to_json(F.struct("voting", F.collect_list(vote).alias("votes"), F.array(link("html", ".html"), link("pdf", ".pdf")).alias("links"))).alias("body"))
    return records.club_votes(texts, ["voting"], "body").select("voting", "club", "yes", "no", "abstain", "absent", "pdf")


@query(
    "SELECT o_custkey, o_orderkey::VARCHAR AS number, 'a' || o_orderkey || '.pdf' AS attachment, 'https://api/prints/' || o_orderkey || '/a' || o_orderkey || '.pdf' AS url, CASE WHEN n > 1 THEN 1 ELSE 0 END AS depth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderkey % 3 <> 0"
)
def print_attachments(spark, sf_dir):
    """A customer's orders as a print and its additional ones, each with its attachments."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    k = F.col("o_orderkey").cast("string")
    own = F.concat(F.lit('"number":"'), k, F.lit('","title":" t ","attachments":'), F.when(F.col("o_orderkey") % 3 == 0, "null").otherwise(F.concat(F.lit('["a'), k, F.lit('.pdf"]'))))
    first = F.min_by(F.struct(own.alias("x")), "n")["x"]
    others = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", own.alias("x"))))), lambda x: F.concat(F.lit("{"), x["x"], F.lit("}"))), ",")
    texts = o.groupBy("o_custkey").agg(F.concat(F.lit('{"prints":[{'), first, F.lit(',"additionalPrints":['), others, F.lit("]}]}")).alias("body"))
    return records.attachments(texts, ["o_custkey"], "body", "https://api/prints").select("o_custkey", "number", "attachment", "url", "depth")


@query("SELECT n_nationkey AS term, DATE '2000-01-01' + n_nationkey AS start, CASE WHEN n_nationkey % 4 > 0 THEN DATE '2000-01-01' + n_nationkey + 30 END AS stop, n_nationkey % 4 = 0 AS current FROM nation")
def term_listing(spark, sf_dir):
    k = F.col("n_nationkey")
    day = lambda n: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), n), "yyyy-MM-dd")
    body = F.to_json(F.collect_list(F.struct(k.alias("num"), day(k).alias("from"), F.when(k % 4 > 0, day(k + 30)).otherwise("soon").alias("to"), F.when(k % 4 == 0, True).alias("current"))))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("body"))
    return records.listed(texts, "body", {"term": ("num", "int"), "start": ("from", "date"), "stop": ("to", "date"), "current": ("current", "boolean")}).withColumn("current", F.coalesce("current", F.lit(False)))


@query("SELECT o_custkey AS number, unnest([o_orderdate::DATE, o_orderdate::DATE + 1]) AS day, o_orderstatus AS status FROM orders")
def sitting_days(spark, sf_dir):
    """Sittings as JSON with a list of days, a row a day; what isn't a day is no row."""
    d = F.to_date("o_orderdate")
    body = F.to_json(F.collect_list(F.struct(F.col("o_custkey").alias("number"), F.col("o_orderstatus").alias("status"), F.array(d.cast("string"), F.lit("n/a"), F.date_add(d, 1).cast("string")).alias("dates"))))
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(body.alias("body"))
    rows = records.listed(texts, "body", {"number": ("number", "bigint"), "status": ("status", "string"), "dates": ("dates", "array<string>")})
    days = rows.select("number", F.explode("dates").alias("day"), "status").withColumn("day", F.col("day").try_cast("date"))
    return days.where("day is not null").select("number", "day", "status")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def lookup_by_key(spark, sf_dir):
    return keyed.looked_up(table(spark, sf_dir, "orders"), {"o_orderkey": 7}).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'O'")
def lookup_by_other_key(spark, sf_dir):
    return keyed.looked_up(table(spark, sf_dir, "orders"), {"o_custkey": 11, "o_orderstatus": "O"}).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderkey, o_orderdate::DATE AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 5")
def lookup_through_child(spark, sf_dir):
    """The orders of one part's lines: found by the child, each once."""
    lines = keyed.looked_up(table(spark, sf_dir, "lineitem"), {"l_partkey": 5}).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


# -- sittings -------------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT c_custkey, unnest([c_custkey, c_custkey + 500]) AS number FROM customer), s AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderstatus AS room, unnest([o_custkey, o_orderkey % 700]) AS number FROM orders)"
    ", m AS (SELECT DISTINCT c_custkey, o_orderkey, day, room FROM b JOIN s USING (number)), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, day, room ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END, o_orderkey) AS n FROM m) SELECT c_custkey, o_orderkey, day, room FROM r WHERE n = 1"
)
def matched_sittings(spark, sf_dir):
    k = F.col("c_custkey")
    bills = table(spark, sf_dir, "customer").select("c_custkey", F.array(k, k + 500).alias("numbers"))
    o = table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("room"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 700).alias("named"))
    told = bills.select("c_custkey", F.explode("numbers").alias("number")).join(s.where("o_orderkey % 5 = 0").select("o_orderkey", F.explode("named").alias("number")), "number").select("c_custkey", "o_orderkey")
    return sittings.matched(bills, "c_custkey", "numbers", s, "o_orderkey", "named", ["day", "room"], told).select("c_custkey", "o_orderkey", "day", "room")


@query(
    "WITH e AS (SELECT user_id, event_type, ts::DATE AS day, event_id FROM events), t AS (SELECT user_id, event_type, max(struct_pack(d := day, r := event_id)) FILTER (event_id % 3 = 0) AS last, max(struct_pack(d := day, r := event_id)) FILTER (event_id % 3 = 0) AS x FROM e GROUP BY 1, 2)"
    " SELECT e.user_id, e.event_type, e.event_id, (SELECT arg_max(o.event_id, struct_pack(d := o.day, r := o.event_id)) FROM e o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND o.event_id % 3 = 0 AND o.event_id <> e.event_id) AS moved_from FROM e WHERE e.event_id % 2 = 1"
)
def moved_sittings(spark, sf_dir):
    """Listed events and the latest one of the same user and kind that was told under another number."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("day"))
    found = sittings.moved(e.where("event_id % 2 = 1").drop("day"), e.where("event_id % 3 = 0"), ["user_id", "event_type"], "event_id", "day")
    return found.select("user_id", "event_type", "event_id", "moved_from")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 3 = 0 THEN list_contains([1 + event_id % 5, 2], 1 + event_id % 2) ELSE list_contains([1 + event_id % 5, 2], CASE WHEN event_id % 2 = 0 THEN 4 ELSE 7 END) END AS covered FROM events"
)
def covered_items(spark, sf_dir):
    """An agenda of two items, numbered by their places or by numerals of their own, and a condition on some points."""
    i = F.col("event_id")
    head = F.when(i % 3 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.lit("IV. "), F.lit("VII. ")))
    items = F.transform(head, lambda h, n: F.concat(h, F.lit("Report on print "), F.when(n == i % 2, i.cast("string")).otherwise("none"), F.lit(".")))
    points = F.when(i % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((1 + i % 5).cast("int"), F.lit(2)))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", sittings.covers(items, F.array(i.cast("string")), points, r"print (\d+)", r"^([IVXLC]+)\.").alias("covered"))


# -- letters, roles, bundles -----------------------------------------------------------------------------

_MONTHS = {m: n for n, m in enumerate("january february march april may june july august september october november december".split(), 1)}


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders) SELECT k, 'REF-' || k || '-24' AS sender, CASE WHEN k % 3 > 0 THEN d END AS written, CASE WHEN k % 2 = 0 THEN (k % 40)::INT END AS days, CASE WHEN k % 5 = 0 THEN d + 10 WHEN k % 5 = 1 THEN d + 400 END AS until, CASE WHEN k % 7 > 0 THEN 'to' || k || '@office.gov' END AS address"
    ", CASE WHEN k % 5 = 0 THEN d + 10 WHEN k % 2 = 0 THEN (CASE WHEN k % 3 > 0 THEN d ELSE d + 1 END) + (k % 40)::INT END AS deadline, 'Ann ' || k || ';Bob Lee' AS names FROM o"
)
def parsed_letters(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    key = k.cast("string")
    written = F.when(k % 3 == 1, F.concat(F.lit("Dated "), F.date_format(d, "d MMMM yyyy"))).when(k % 3 == 2, F.concat(F.lit("Dated "), F.date_format(d, "dd.MM.yyyy"))).otherwise("Dated 31.02.2024")
    days = F.when(k % 2 == 0, F.concat(F.lit(" Comments within "), (k % 40).cast("string"), F.lit("\n days."))).otherwise("")
    until = F.when(k % 5 == 0, F.concat(F.lit(" No later than "), F.date_format(F.date_add(d, 10), "d  MMMM yyyy"), F.lit("."))).when(k % 5 == 1, F.concat(F.lit(" No later than "), F.date_format(F.date_add(d, 400), "dd.MM.yyyy"), F.lit("."))).otherwise("")
    address = F.when(k % 7 > 0, F.concat(F.lit(" Send them to: to"), key, F.lit("@office.gov, please."))).otherwise(" Switchboard info@office.gov.")
    text = F.concat(F.lit("Ref – 1 "), F.lit("REF – "), key, F.lit("–24\n"), written, F.lit("\n"), days, until, address, F.lit("\nSigned: Ann  "), key, F.lit("\nSigned: Bob Lee\nSigned: \nEnclosure follows\nSigned: Nobody"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(d, 1).alias("published"), text.alias("text"))
    t = F.col("text")
    told = letters.consultation(t, _MONTHS, r"Dated (\S+(?: \S+ \d{4})?)", r"within (\d+) days", r"No later than ([^.]+(?:\.\d+\.\d+)?)", r"to: (\S+@[\w.]*\w)")
    o = o.withColumn("told", told)
    names = F.array_join(letters.signatories(t, r"Signed:[ \t]*([^\n]*)", ["Enclosure"], 3000), ";")
    return o.select(F.col("o_orderkey").alias("k"), letters.sender_number(t, r"REF\s*[-–]\s*\d+\s*[-–]\s*\d+", 3000).alias("sender"), "told.*", letters.deadline(F.col("told"), F.col("published"), 120).alias("deadline"), names.alias("names"))


#: What a file of a folder is by its name; a tag in brackets beats all.
_ROLES = (("bill", r"\[draft\]"), ("reasons", r"\[reasons\]"), ("", "annex|appendix"), ("reasons", "reason"), ("impact", "impact"), ("", "table|list"))


@query(
    "SELECT role, count(*) AS n FROM (SELECT CASE l_partkey % 8 WHEN 0 THEN 'bill' WHEN 1 THEN 'reasons' WHEN 2 THEN '' WHEN 3 THEN 'reasons' WHEN 4 THEN 'impact' WHEN 5 THEN '' WHEN 6 THEN 'bill' ELSE 'bill' END AS role FROM lineitem) GROUP BY 1"
)
def text_roles(spark, sf_dir):
    names = ("Annex [DRAFT].pdf", "list [reasons].doc", "Appendix to impact.pdf", "Reasoning.docx", "Impact sheet.pdf", "Table of notes.pdf", "Draft bill.pdf", "scan001.pdf")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % 8 + 1).cast("int"))
    rules = [(F.lower(name).rlike(p), r) for r, p in _ROLES]
    return table(spark, sf_dir, "lineitem").select(decisions.first_rule(rules, "bill").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'annex' WHEN l_linestatus = 'F' OR l_quantity > 25 THEN 'bill' ELSE '' END AS role, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS r, l_tax AS d, l_discount > 0.08 AS lost FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)),
 b AS (SELECT o, min(r) FILTER (role = 'bill') AS least, count(*) AS parts FROM p GROUP BY 1),
 c AS (SELECT p.o, any_value(parts) AS parts, min(n) FILTER (role = 'bill' AND r = least) AS best, arg_min(lost, n) FILTER (role = 'bill' AND r = least) AS best_lost, count(DISTINCT d) FILTER (role = 'bill' AND r = least) AS texts, string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (role = 'annex') AS annexes, count(*) FILTER (role = 'annex') AS k, coalesce(bool_or(lost) FILTER (role = 'annex'), false) AS annex_lost FROM p JOIN b USING (o) GROUP BY 1),
 s AS (SELECT *, CASE WHEN best IS NULL THEN 'none' WHEN texts > 1 THEN 'conflict' WHEN best_lost OR annex_lost THEN 'waiting' ELSE 'chosen' END AS state FROM c)
 SELECT o AS l_orderkey, state, CASE WHEN state IN ('waiting', 'chosen') THEN best END AS chosen, CASE WHEN state IN ('waiting', 'chosen') THEN coalesce(annexes, '') ELSE '' END AS annexes, CASE WHEN state IN ('waiting', 'chosen') THEN parts - 1 - k ELSE parts END AS rejected FROM s"""
)
def selected_parts(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    # lines of one number would be ties: the first of each stays
    li = keyed.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])
    roles = [(flag == "R", "annex"), ((status == "F") | (F.col("l_quantity") > 25), "bill")]
    found = selection.selected(li, ["l_orderkey"], "l_linenumber", roles, "bill", "annex", [F.when(status == "F", 0).otherwise(1)], F.col("l_tax").cast("string"), F.col("l_discount") > 0.08)
    return found.select("l_orderkey", "state", "chosen", F.array_join("annexes", ",").alias("annexes"), F.col("rejected").cast("long").alias("rejected"))


@query(
    "SELECT doc_id, n >= 200 AND n * 1.0 / pages >= 40 AS carries, CASE WHEN doc_id % 2 = 0 AND pages > 1 THEN 1 ELSE 0 END AS first, pages - CASE WHEN doc_id % 2 = 0 AND pages > 1 THEN 1 ELSE 0 END AS count FROM (SELECT doc_id, length(trim(text, ' ')) AS n, len(string_split(text, chr(10))) AS pages FROM documents WHERE text IS NOT NULL)"
)
def carried_texts(spark, sf_dir):
    pages_ = F.size(F.split("text", "\n"))
    d = table(spark, sf_dir, "documents").where("text is not null")
    window = selection.page_window(pages_, F.col("doc_id") % 2 == 0)
    d = d.select("doc_id", selection.carries_text(F.col("text"), pages_, 200, 40.0).alias("carries"), window.alias("w"))
    return d.select("doc_id", "carries", F.col("w.first").alias("first"), F.col("w.count").cast("long").alias("count"))


@query(
    "WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders), n(k) AS (SELECT k FROM o WHERE d >= DATE '1998-01-01' UNION SELECT o.p FROM n JOIN o ON o.k = n.k WHERE o.p IS NOT NULL AND o.k % 4 <> 0) SELECT k FROM o WHERE d < DATE '1998-01-01' AND k NOT IN (SELECT k FROM n)"
)
def prunable_through_others(spark, sf_dir):
    """An order needs the one before it, but for every fourth: old orders that nothing kept needs, directly or through others."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.lag("o_orderkey").over(w).alias("p"))
    return selection.prunable(o, "k", F.col("d") < F.lit("1998-01-01").cast("date"), o.where("k % 4 <> 0"), "k", "p").select("k")


# -- news, reasons, keys ------------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT user_id, ts::DATE AS day, bool_or(event_type = 'purchase' AND value > 60 OR event_type = 'error' AND value > 80) AS stage, bool_or(event_type = 'signup') AS closed, bool_or(event_type = 'click' AND value > 95) AS act, bool_or(event_type = 'view' AND value > 97) AS filed FROM events GROUP BY 1, 2) SELECT day, count(*) FILTER (stage OR filed OR closed AND NOT act) AS news, count(*) FILTER (NOT (stage OR filed OR closed AND NOT act)) AS silent FROM s GROUP BY 1"
)
def daily_news(spark, sf_dir):
    """Changes of a user's day that are worth a post: a substantive stage, a filed document, or an end that no act says already."""
    t, v = F.col("event_type"), F.col("value")
    found = decisions.news(
        table(spark, sf_dir, "events"), ["user_id", F.to_date("ts").alias("day")], substantive=((t == "purchase") & (v > 60)) | ((t == "error") & (v > 80)), always=(t == "view") & (v > 97), unless_said=t == "signup", said=(t == "click") & (v > 95)
    )
    return found.groupBy("day").agg(F.count_if("news").alias("news"), F.count_if(~F.col("news")).alias("silent"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 100 THEN 'triage' WHEN quality = 1 THEN 'score ' || length(text) % 10 ELSE 'not relevant' END AS reason FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def verdict_reasons(spark, sf_dir):
    size = F.length("text")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(decisions.verdict(size < 100, F.col("quality") == 1, size % 10).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderkey, sha256('=' || o_orderstatus || chr(31) || '=' || o_custkey || chr(31) || CASE WHEN o_orderstatus = 'F' THEN '=closed' ELSE '-' END || chr(31) || CASE WHEN parts IS NULL THEN '-' ELSE '=' || parts END) AS change_key FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey"
)
def change_keys(spark, sf_dir):
    """A key for each state of an order: its status, owner, end and the parts filed to it, in whatever order they came."""
    parts = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    o = table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left")
    key = wording.change_key([F.col("o_orderstatus"), F.col("o_custkey")], F.col("o_orderstatus") == "F", F.col("parts"))
    return o.select("o_orderkey", key.alias("change_key"))


# -- single expressions -------------------------------------------------------------------------------------


@query(
    """SELECT event_id, '{"a":' || event_id || CASE WHEN event_id % 3 = 0 THEN ',"c":{"x":[1,"t"]}' WHEN event_id % 3 = 1 THEN ',"c":' || event_id % 10 ELSE '' END || ',"e":null}' AS rest FROM events"""
)
def json_pruned(spark, sf_dir):
    """A payload without a member and a member's member; types stay."""
    i = F.col("event_id")
    inner = F.when(i % 3 == 0, ',"c":{"x":[1,"t"],"text":"long"}').when(i % 3 == 1, F.concat(F.lit(',"c":'), (i % 10).cast("string"))).otherwise("")
    body = F.concat(F.lit('{"text":"long","e":null'), inner, F.lit(',"a":'), i.cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", json.without_paths(body, "text", "c.text", "none.at.all").alias("rest"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN date_trunc('week', o_orderdate)::DATE END AS start, CASE WHEN o_orderkey % 9 > 0 THEN date_trunc('week', o_orderdate)::DATE + 6 END AS stop FROM orders"
)
def week_days(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 9 > 0, dates.iso_week(F.to_date("o_orderdate"))).when(F.col("o_orderkey") % 2 == 0, "2023-W53").otherwise("2024-W00")
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.week_bounds(label).alias("w"))
    return o.select("o_orderkey", F.col("w.start").alias("start"), F.col("w.end").alias("stop"))


@query(
    "WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, event_type, (props->>'$.k')::BIGINT AS k FROM events), r AS (SELECT month, count(*) AS runs FROM e GROUP BY 1) SELECT month, event_type AS entry, sum(k)::BIGINT AS amount, any_value(runs) AS runs FROM e JOIN r USING (month) GROUP BY 1, 2"
)
def month_usage(spark, sf_dir):
    """A month's runs beside what its runs used, maps of counters added up."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    e = table(spark, sf_dir, "events").select(month, F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("long")).alias("used"))
    return figures.merged_maps(e, [F.col("month")], "used").join(e.groupBy("month").agg(F.count("*").alias("runs")), "month")


@query(
    r"""WITH t AS (SELECT doc_id, text || ' (print ' || doc_id || ') end' AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, t, substr(t, strpos(t, '(print ' || doc_id || ')') + 1, 60) AS tail, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(substr(t, 1, 120), '\s+\S*\z', '') || '...' END AS head FROM t)
 SELECT doc_id, CASE WHEN length(t) > 120 AND NOT contains(head, '(print ' || doc_id) THEN regexp_replace(substr(t, 1, 116 - length(tail)), '\s+\S*\z', '') || '... ' || tail ELSE head END AS clip FROM k"""
)
def clipped_references(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" (print "), key, F.lit(") end")).alias("t"))
    return d.select("doc_id", text.clipped_keeping(F.col("t"), 120, "print ", F.array(key)).alias("clip"))


@query("SELECT source, count(*) AS n FROM documents WHERE contains(lower(coalesce(text, '')), 'handed') OR len(list_filter(string_split(source || ',' || lang, ','), lambda x: contains(lower(x), 'fr'))) > 0 GROUP BY 1")
def folded_lists(spark, sf_dir):
    """Texts or any tag of theirs that hold a word, whatever its case."""
    tags = F.array(F.col("source"), F.upper("lang"), F.lit(None).cast("string"))
    d = table(spark, sf_dir, "documents")
    return d.where(text.any_contains_folded(F.col("text"), F.array(F.lit("none")), "HANDED") | text.any_contains_folded(F.lit(None).cast("string"), tags, "Fr")).groupBy("source").agg(F.count("*").alias("n"))
