"""The queries of this subpackage, one an operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import documents, held_out
from gristmill.llm.decontamination import contaminated_pairs
from gristmill.llm.languages import language_ids
from gristmill.llm.merkle import FIELDS, leaf_hash, merkle_manifest, siblings, verified
from gristmill.llm.near_duplicates import near_duplicates
from gristmill.llm.near_vectors import near_vectors
from gristmill.llm.packing import pack_documents
from gristmill.llm.prefix_trie import conversation_trie
from gristmill.llm.private import personal_data
from gristmill.llm.repeated_passages import without_repeats
from gristmill.llm.secret_scan import secrets
from gristmill.llm.token_counts import token_counts
from gristmill.llm.token_files import token_file_round_trip
from gristmill.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what every second document gives with the line breaks of its text gone."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = leaf_hash([text if f == "text" else F.col(f) for f in FIELDS])
    found = verified(merkle_manifest(documents(spark, sf_dir), keep={"doc_id": F.col("doc_id"), "leaf_now": now}), "leaf_now")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every letter-bearing text gets a language; ``rejected`` tells what calibration would turn away."""
    found = language_ids(documents(spark, sf_dir), reject=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_personal_data,
        op3_token_counts,
        op4_repeated_passages,
        op5_toxicity,
        op6_secrets,
        op7_near_vectors,
        op8_token_files,
        op9_near_duplicates,
        op10_packing,
        op11_merkle_manifest,
        op12_prefix_trie,
        op13_language_id,
    )
}

_OP4 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), windows AS (
  SELECT r, i, array_to_string(l[i:i + 34], ' ') AS w FROM (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM texts WHERE len(l) >= 35)
), again AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), marks AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows JOIN again USING (w)
), words AS (
  SELECT r, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN marks USING (r, p) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

_OP7 = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(v, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.c = l.a
), least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON v = e.vec_id LEFT JOIN counts ON a = e.vec_id
"""

_OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, l[i] || ' ' || l[i + 1] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM words)
    UNION ALL SELECT doc_id, l[1] FROM words WHERE len(l) = 1)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.v, l.b FROM reach r JOIN both_ways l ON r.c = l.a
), least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: crc32 of a number's digits: a byte is taken in, then eight steps (-1) of the shift register.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}::VARCHAR, ''),
  lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _leaf(text: str) -> str:
    told = ["coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format(c) for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(told)})"


_OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf, now
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC.format('doc_id')} & 1 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now FROM documents)
), lower_nodes(tree, level, i, h) AS (
  SELECT tree, 0, i, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lower_nodes GROUP BY tree, level, i // 3
    HAVING any_value((SELECT count(*) FROM lower_nodes x WHERE x.tree = lower_nodes.tree)) > 1
), subroots AS (
  SELECT tree, level, h FROM lower_nodes QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1
), upper_nodes(level, i, h) AS (
  SELECT 0, tree, h FROM subroots
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes GROUP BY level, i // 3
    HAVING any_value((SELECT count(*) FROM upper_nodes)) > 1
), top AS (SELECT h FROM upper_nodes ORDER BY level DESC LIMIT 1),
lower_steps AS (
  SELECT n.tree, n.level, n.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < n.i), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > n.i), '') AS b
  FROM lower_nodes n JOIN subroots r ON r.tree = n.tree AND n.level < r.level JOIN lower_nodes s ON s.tree = n.tree AND s.level = n.level AND s.i // 3 = n.i // 3 GROUP BY n.tree, n.level, n.i
), upper_steps AS (
  SELECT n.level, n.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < n.i), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > n.i), '') AS b
  FROM upper_nodes n JOIN upper_nodes s ON s.level = n.level AND s.i // 3 = n.i // 3 WHERE n.level < (SELECT max(level) FROM upper_nodes) GROUP BY n.level, n.i
), steps AS (
  SELECT l.tree, l.i AS leaf_i, s.level, a, b FROM leaves l JOIN lower_steps s ON s.tree = l.tree AND s.i = l.i // (3 ** s.level)::BIGINT
  UNION ALL SELECT l.tree, l.i, 100 + u.level, a, b FROM leaves l JOIN upper_steps u ON u.i = l.tree // (3 ** u.level)::BIGINT
), proofs AS (
  SELECT tree, leaf_i AS i, list([a, b] ORDER BY level) AS p, string_agg(a || b, '' ORDER BY level) AS t FROM steps GROUP BY ALL
)
SELECT doc_id, leaf, r.h AS subroot, top.h AS root, sha256(coalesce(t, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified FROM (
  SELECT l.*, t, CASE WHEN p IS NULL THEN now ELSE list_reduce(list_concat([[now]], p), lambda f, s: [sha256(s[1] || f[1] || s[2])])[1] END AS folded_root
  FROM leaves l LEFT JOIN proofs USING (tree, i)
) JOIN subroots r USING (tree), top
"""

_OP12 = f"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS place, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, {_CRC.format('conv_id')} % 9 AS h, conv_id - conv_id % 5 AS source FROM (SELECT DISTINCT conv_id FROM placed)
), parts AS (
  SELECT c.conv_id, 0 AS side, place, role, text FROM convs c JOIN placed p ON p.conv_id = c.source AND place <= h
  UNION ALL SELECT conv_id, 1, place, role, text FROM convs JOIN placed USING (conv_id) WHERE place > h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS d, sha256(strlen(role)::VARCHAR || ':' || role || text) AS k, strlen(text) AS b FROM parts
), prefixes AS (
  SELECT conv_id, d, b, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, d = count(*) OVER (PARTITION BY conv_id) AS ends FROM turns
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM convs
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:64 * (d - 1)] AS path, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1
), known AS (
  SELECT n.*, coalesce(c, 0) AS c FROM nodes n LEFT JOIN children USING (path)
), sums AS (
  SELECT path[1:64 * u] AS path, sum((c = 0)::INT) AS leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM known) GROUP BY 1
)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.c AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM known k JOIN sums USING (path) LEFT JOIN nodes p ON k.d > 0 AND p.path = k.path[1:64 * (k.d - 1)]
"""

#: The others hold a model, a tokenizer or a greedy choice; their tests compare with brute force.
ORACLE_SQL = {"op4_repeated_passages": _OP4, "op7_near_vectors": _OP7, "op9_near_duplicates": _OP9, "op11_merkle_manifest": _OP11, "op12_prefix_trie": _OP12}
