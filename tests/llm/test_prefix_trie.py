"""The trie of conversations against one built node by node, by SQL, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from gristmill.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth string, p1 int, bytes int, point string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[r[0]].append((r[1] is not None, r[1] or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    found = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        found[c] = turns.get(c - rest, [])[:h] + t[h:]
    return found


def brute_trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return Counter(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, who in members.items()
    )


def odd_rows():
    r = random.Random(3)
    says = [("user", "hi"), ("user", "é漢"), ("assistant", "hi"), (None, None), ("", ""), ("system", "long " * 2000)]
    rows = []
    for c in range(-12, 60):
        n = r.choice([1, 2, 3, 9, 14])
        same = random.Random(c % 3)
        rows += [(c, i if i else None, *(same if i < 10 else r).choice(says[:4])) for i in range(n)]
    rows += [(100 + i, j, "user", f"turn {j}") for i in range(50) for j in range(12)]  # copies
    rows += [(200, j, "user", f"t{j // 2}") for j in range(700)] + [(203, j, "user", f"t{j // 2}") for j in range(600)] + [(204, j, "user", "x") for j in range(9)]
    rows += [(301, 5, "a", "x"), (301, 5, "a", "x"), (301, 5, "b", "y"), (None, 1, "user", "nobody"), (302, 1, *says[5]), (303, 1, *says[4])]
    return [(*x, 1, "d", 2, 3, "p") for x in rows]


def test_trie_is_the_plain_one(spark):
    rows = odd_rows()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == NAMES
    assert Counter(map(tuple, got.collect())) == brute_trie(brute_rebuilt(rows))


def test_conversations_without_turns_and_none(spark):
    # every conversation whose own turns are all left out, and no source to start from
    lost = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:20]
    rows = [(c, 1, "user", "x", 1, "d", 2, 3, "p") for c in lost]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_trie(brute_rebuilt(rows)) and len(got) == 1 and got[0].n_leaves == 1
    empty = prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == NAMES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_prefix_trie"])
    got = queries.QUERIES["op12_prefix_trie"](spark, f"/root/testdata/{sf}")
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
