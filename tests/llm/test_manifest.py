"""The Merkle manifest against plain hashing, by SQL, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.llm import merkle, queries, scans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, place int, scan_kept string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)])


def brute_tree(leaves):
    """The root, and for each leaf (siblings before, siblings after) level by level."""
    paths, below = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        up, members = [], []
        for a in range(0, len(leaves), 3):
            run = leaves[a : a + 3]
            for j in range(len(run)):
                for m in below[a + j]:
                    paths[m].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            members.append(sum(below[a : a + 3], []))
        leaves, below = up, members
    return leaves[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, upper = brute_tree([trees[s][0] for s in names])
    return [(i if known else None, leaf, trees[s][0], root, p + u) for s, u in zip(names, upper) for (known, i, leaf), p in zip(sorted(groups[s]), trees[s][1])]


def as_text(path):
    return "/".join("".join(a) + "|" + "".join(b) for a, b in path)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"text {i}\n", "en", "hot", 5, "x", 1, 2, "k") for i in range(800)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, "", "", "", 0, "", 0, 0, ""), (3, "same", "de", "b", 4, "y", 9, 9, "z"), (3, "same", "de", "b", 4, "y", 9, 9, "z")]
    rows += [(3, "other", None, "b", 4, "y", 9, 9, "z"), (-7, "é\n漢" * 50_000, "fr", "é", 7, "", 0, 0, ""), (5, "", "fr", "z", None, "", 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_manifest_is_the_plain_tree(spark, odd):
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in merkle.merkle_manifest(odd).collect())
    want = Counter((*x[:4], as_text(x[4])) for x in brute_manifest(odd.collect()))
    assert got == want
    checked = merkle.verified(merkle.merkle_manifest(odd, keep={"doc_id": F.col("doc_id"), "now": merkle.leaf_hash([F.col("doc_id")])}))
    assert checked.where("not verified").count() == 0 and checked.count() == odd.count()
    assert merkle.verified(checked.drop("folded_root", "verified"), "now").where("verified").count() == 0


def test_manifest_of_one_row_and_of_none(spark, odd):
    one = merkle.merkle_manifest(odd.where("source = 'z'")).collect()
    assert [(r.proof, r.leaf == r.subroot == r.root) for r in one] == [("", True)]
    none = merkle.merkle_manifest(odd.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    with pytest.raises(ValueError):
        merkle.merkle_manifest(odd, keep={"leaf": F.col("leaf")})


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_merkle_manifest"])
    got = queries.QUERIES["op11_merkle_manifest"](spark, SF)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_running_values_across_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 37) % 101, i if i % 5 == 0 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "k string, i int, x long, y long").repartition(5)
    per = spark.createDataFrame([("hot", 8)], "k string, extra int")
    got = scans.running(d, "k", [F.col("i")], sums=["x"], fills=["y"], previous=["x"], per_key=per).collect()
    want, sizes = {}, Counter(k for k, *_ in rows)
    state = {}
    for k, i, x, y in rows:
        place, total, last, before = state.get(k, (0, 0, None, None))
        state[k] = (place + 1, total + x, last if y is None else y, x)
        want[i] = (place + 1, sizes[k], total + x, state[k][2], before, 8 if k == "hot" else None)
    assert {r.i: (r.place, r.rows, r.running_x, r.filled_y, r.previous_x, r.extra) for r in got} == want
    assert {r.total_x for r in got if r.k == "hot"} == {state["hot"][1]}
