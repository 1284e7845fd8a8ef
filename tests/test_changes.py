"""Trees in JSON, differences, alignment, machines, listings, splits and merged sources against plain Python."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import alignment, differences, inspection, json_trees, machines, markup, merging, places, splits, versions


def test_trees_of_any_depth(spark):
    deep = {"name": "x", "children": []}
    for i in range(40):
        deep = {"children": [deep, {"name": None}], "name": f"n{i}"}
    texts = [json.dumps({"stages": [deep, {"name": 5, "children": "no"}]}), "", "{", None, '{"stages":{"name":"x"}}', '{"stages":[]}', "[1]"]
    d = spark.createDataFrame(list(enumerate(texts)), "owner int, node string")
    got = json_trees.tree_rows(d, ["owner"], "node", "$.stages", "$.children", {"name": ("$.name", "string")}).collect()

    def walk(node, path):
        yield (0, path, None if node.get("name") is None else str(node["name"]))
        for i, c in enumerate(node["children"] if isinstance(node.get("children"), list) else []):
            yield from walk(c, [*path, i])

    assert sorted((r.owner, r.path, r.name) for r in got) == sorted(itertools.chain(walk(deep, [0]), walk({"name": 5}, [1])))
    assert len(got) == 82


def test_trees_are_walked_once_and_in_order(spark, monkeypatch):
    def no_pass(*_):
        raise AssertionError("a pass for a level")

    monkeypatch.setattr(json_trees, "kept", no_pass)
    monkeypatch.setattr(json_trees, "TOGETHER", 7)
    r, made = random.Random(3), []

    def tree(depth):
        return {"n": {"v": r.choice([None, "é", 5, "7", 1.5, True, 12345678901, [1]])}, "c": [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else r.choice([None, {}, 4])}

    def walk(k, nodes, path):
        for i, x in enumerate(nodes):
            made.append((k, [*path, i], x["n"]["v"]))
            walk(k, x["c"] if isinstance(x["c"], list) else [], [*path, i])

    trees = [[tree(4) for _ in range(r.randint(0, 3))] for _ in range(30)]
    for k, t in enumerate(trees):
        walk(k, t, [])
    d = spark.createDataFrame([(k, str(k), json.dumps([0, {"a": t}])) for k, t in enumerate(trees)], "k int, k2 string, t string")
    fields = {"s": ("$.n.v", "string"), "i": ("$.n['v']", "int"), "l": ("$.n.v", "array<int>")}
    whole = {5: 5, "7": 7, 1.5: 1, True: 1}
    said = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    want = [(k, str(k), path, said(v), None if isinstance(v, list) else whole.get(v), v if isinstance(v, list) else None) for k, path, v in made]
    assert sorted(map(tuple, json_trees.tree_rows(d, ["k", "k2"], "t", "$[1].a", "$.c", fields).collect())) == want
    got = sorted(map(tuple, json_trees.tree_places(d, ["k"], "t", "$[1].a", "$.c", fields).collect()), key=lambda x: x[:2])
    first = {k: n for n, (k, *_) in reversed(list(enumerate(want)))}
    assert got == [(w[0], n - first[w[0]], len(w[2]) - 1, *w[3:]) for n, w in enumerate(want)]


def test_odd_texts_of_trees(spark):
    inside = lambda x: '{"s":[' + x + "]}"
    texts = [inside('{"n":"one","n":"two"}'), inside('{"n":"\\ud800x"}'), inside('{"n":NaN}'), inside('{"n":1},'), inside('{"n":"a\tb"}'), inside('{"n":1.0},null,[2],"x"'), inside("[" * 1200 + "]" * 1200), '{"s":null}']
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted(map(tuple, json_trees.tree_places(d, ["k"], "t", "$.s", "$.c", {"n": ("$.n", "string")}).collect()))
    assert got == [(0, 0, 0, "one"), (1, 0, 0, "?x"), (5, 0, 0, "1.0"), (5, 1, 0, None), (5, 2, 0, None), (5, 3, 0, None), (6, 0, 0, None)]
    with pytest.raises(ValueError, match="not a path"):
        json_trees.tree_rows(d, ["k"], "t", "s", "$.c", {})


def test_named_values_at_any_depth(spark):
    texts = ['{"a":1,"b":[{"a":"x"},[{"a":{"a":null}}]]}', "", "no", None, '{"it\'s":2,"A":3}', '{"a":[1,{"a":2}]}']
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted((r.k, r.path, r.value) for r in json_trees.named_values(d, ["k"], "t", "a").collect())
    assert got == [(0, [], "1"), (0, [1, 0], "x"), (0, [1, 1, 0], '{"a":null}'), (5, [], '[1,{"a":2}]'), (5, [0, 1], "2")]
    assert [r.value for r in json_trees.named_values(d, ["k"], "t", "it's").collect()] == ["2"]


def test_tree_prints_follow_shape_and_fields(spark):
    trees = {1: [([0], "a"), ([0, 0], "b"), ([0, 1], "c")], 2: [([0], "a"), ([0, 3], "b"), ([0, 7], "c")], 3: [([0], "a"), ([0, 0], "b"), ([0, 0, 0], "c")], 4: [([0], "a"), ([0, 0], "c"), ([0, 1], "b")], 5: [([0], "a"), ([0, 0], None), ([0, 1], "c")]}
    rows = [(p, path, n) for p, t in trees.items() for path, n in t]
    d = spark.createDataFrame(rows, "p int, path array<int>, own string")
    prints = {r.p: r.fingerprint for r in json_trees.tree_prints(d, ["p"], [F.col("own")]).collect()}
    assert prints[1] == prints[2] and len(set(prints.values())) == 4
    assert json_trees.tree_prints(d.limit(0), ["p"], [F.col("own")]).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words_and_chains_are_the_best_there_are():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert differences.common_words(a, b) == plain_lcs(a, b)
    for _ in range(200):
        n = r.randint(0, 8)
        runs = list(zip(range(n), r.sample(range(n), n), [r.randint(1, 5) for _ in range(n)]))
        best = max(sum(x[2] for x in c) for k in range(n + 1) for c in itertools.combinations(runs, k) if all(x[1] < y[1] for x, y in itertools.pairwise(c)))
        chain = differences.heaviest_chain(runs)
        assert sum(x[2] for x in chain) == best and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(chain))


def test_differences_between_texts(spark):
    r = random.Random(2)
    pairs = [(i, t := " ".join(r.choice("abcdefghij") + r.choice(["", ".", ";"]) for _ in range(r.randint(0, 60))), "".join(c if r.random() > 0.03 else "x" for c in t) + r.choice(["", " more words."])) for i in range(60)]
    pairs += [(100, None, None), (101, "a b", None), (102, "One two. Three four!", "one TWO;\n three   four"), (103, "x y. moved here. z w.", "z w. x y. moved here.")]
    d = spark.createDataFrame(pairs, "pair int, x string, y string").withColumnRenamed("pair", "gap")
    got = {r.gap: r for r in differences.differences(d, ["gap"], "x", "y").collect()}
    assert set(got) == {p[0] for p in pairs}
    for i, a, b in pairs:
        x, y = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (a, b))
        g = got[i]
        assert g.words == max(len(x), len(y)) and len(x) - g.removed == len(y) - g.added <= plain_lcs(x, y) and (g.changed == 0) == (x == y)
        assert max(g.removed, g.added) <= g.changed <= g.removed + g.added
    assert (got[102].hunks, got[101].removed, got[103].removed, got[103].added) == (0, 2, 2, 2)
    bands = {r.gap: r.band for r in differences.bands(d, ["gap"], "x", "y", 0.5, 4).collect()}
    assert bands[100] == bands[101] == "nothing" and bands[102] == "noise" and bands[103] == "large"


def test_texts_are_compared_where_they_lie(spark):
    d = spark.createDataFrame([(1, "One two. Three four. Five.", "One two. Three six. Five, seven."), (2, "a b", "a b"), (3, None, "x")], "gap int, x string, y string")
    for found in (differences.differences(d, ["gap"], "x", "y"), differences.bands(d, ["gap"], "x", "y", 0.5, 2)):
        assert "Exchange" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in differences.differences(d, ["gap"], "x", "y").orderBy("gap").collect()] == [(1, 6, 1, 1, 2, 2), (2, 2, 0, 0, 0, 0), (3, 1, 1, 0, 1, 1)]
    assert [tuple(r) for r in differences.bands(d, ["gap"], "x", "y", 0.5, 2).orderBy("gap").collect()] == [(1, "review", 2, 6), (2, "equal", None, None), (3, "nothing", None, None)]


def test_stretches_hold_all_neighbours(spark):
    r = random.Random(6)
    keys = {"a": r.sample(range(-500, 500), 90), "b": [5], "c": [-(2**63), -(2**63) + 1, 0, 7, 2**63 - 2, 2**63 - 1], "d": [2**62 + i for i in range(40)], "e": [*range(30), 10**12]}
    d = spark.createDataFrame([(k, i) for k, ids in keys.items() for i in ids], "_to string, _last long")
    want = {(k, *x) for k, ids in keys.items() for x in itertools.pairwise([None, *sorted(ids)])}
    for most in (1, 2, 7, 1_000):
        got, pairs, sizes = {}, set(), {}
        for x in places.stretches(d, "_to", "_last", "n", "again", most).collect():
            got.setdefault((x._to, x.n), []).append((x._last, x.again))
        for (k, n), rows in got.items():
            rows.sort()
            assert [again for _, again in rows] == [n > 0, *[False] * (len(rows) - 1)]
            pairs |= {(k, a, b) for a, b in itertools.pairwise([x for x, _ in rows])} | ({(k, None, rows[0][0])} if not n else set())
            sizes[k] = max(sizes.get(k, 0), len(rows))
        assert pairs == want and ((sizes["a"] < 20 and sizes["e"] < 20) or most > 7)


def test_each_text_meets_the_one_before_it(spark):
    r = random.Random(7)
    rows = [(g, g * 10_000 + i * 3, " ".join(r.choice("abc") + r.choice(["", "."]) for _ in range(r.randint(0, 9)))) for g, n in ((0, 2_600), (1, 3), (2, 1), (3, 2)) for i in range(n)]
    rows += [(3, 39_000, None), (3, None, "x")]
    d = spark.createDataFrame(rows, "_old int, _new long, t string")
    found = differences.successive(d, "_old", "_new", "t", "before")
    got = {(x._new, x.before): tuple(x)[2:] for x in found.collect()}
    told = lambda t: "\n".join(s for s in (" ".join(re.findall(r"\w+", s)) for s in re.split(r"(?<=\.) ", t or "")) if s)
    texts = {i: t for _, i, t in rows if i is not None}
    ids = [sorted(i for g, i, _ in rows if g == k and i is not None) for k in range(4)]
    assert got == {(b, a): differences.compared(told(texts[a]), told(texts[b])) for x in ids for a, b in itertools.pairwise(x)}
    # texts are dealt once, not joined
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def brute_alignment(old, new):
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", new)]
    end, out = 0, []
    for n, line in enumerate(old.split("\n")):
        cells = line.split("\t")
        if len(cells) < 4 or not re.fullmatch(r"\s*[-+]?\d[\d\s.,]*%?\s*", cells[-1]):
            continue
        body, value = (re.findall(r"[^\W_]+", t.lower()) for t in (" ".join(cells[:-1]), cells[-1]))
        if not body:
            continue
        forms = {tuple(body[:o] + value + body[o:]) for o in range(len(body) + 1)}
        size = len(body) + len(value)
        at = next((p for p in range(end, len(words) - size + 1) if tuple(w[0] for w in words[p : p + size]) in forms), None)
        if at is not None:
            end = at + size
            out.append((n, new[words[at][1] : words[end - 1][2]]))
    return out


def test_tables_align_by_a_cursor_that_moves_on(spark):
    r = random.Random(8)
    texts = [(-1, "a\tb\tc\tno\nonly\t1", "a b c no"), (-2, None, None), (-3, "a\ta\ta\t1\na\ta\ta\t1", "a 1 a a 1 a a"), (-4, "\t\t\t5", "5")]
    for i in range(40):
        lines = ["\t".join([*(r.choice("ab") for _ in range(3)), str(r.randint(1, 2))]) for _ in range(6)]
        new = [r.choice([c, c[::-1], c + ["x"]])[:] for c in ([*x.split("\t")] for x in lines)]
        r.random() < 0.3 and r.shuffle(new)
        texts.append((i, "\n".join(lines), " ".join(w for c in new for w in c)))
    d = spark.createDataFrame(texts, "line int, a string, b string").withColumnRenamed("line", "doc")
    got = {}
    for x in alignment.aligned(d, ["doc"], "a", "b").collect():
        got.setdefault(x.doc, []).append((x.line, x.found))
    want = {i: brute_alignment(a, b) for i, a, b in texts if a is not None}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_chains_of_many_pairs_are_folded_as_rows(spark):
    r = random.Random(4)
    runs = {f"p{k}": [(i, j, r.randint(1, 3)) for i, j in zip(range(8), r.sample(range(8), 8), strict=True)][: k % 9] for k in range(60)}
    d = spark.createDataFrame([(p, *x) for p, xs in runs.items() for x in xs], "pair string, i int, j int, n long")
    got = {}
    for x in differences._chains(d).orderBy("pair", "gap").collect():
        got.setdefault(x.pair, []).append((x.gap, x.i, x.j, x.n))
    assert got == {p: [(g, *x) for g, x in enumerate(differences.heaviest_chain(xs), 1)] for p, xs in runs.items() if xs}


def test_tables_align_without_a_shuffle_of_words(spark):
    d = spark.createDataFrame([(1, "Line 1\tpart 7\tflag A\t12", "X. LINE 1  12, Part 7 flag a. y")], "doc int, a string, b string")
    found = alignment.aligned(d, ["doc"], "a", "b")
    assert [(r.line, r.start, r.end, r.found) for r in found.collect()] == [(0, 3, 28, "LINE 1  12, Part 7 flag a")]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_machines_go_through_chunks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(k, i, [r.randrange(5) for _ in range(5)]) for k, n in (("a", 40), ("b", 1), (None, 17)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, n int, m array<int>")
    want, state = {}, {}
    for k, i, m in rows:
        before = state.get(k, 2)
        state[k] = m[before]
        want[k, i] = (before, m[before])
    for chunk in (2, 3, 256):
        monkeypatch.setattr(machines, "CHUNK", chunk)
        got = {(x.owner.k, x.place): (x.before, x.after) for x in machines.states(d, ["k"], "n", F.col("m"), 2, 5).collect()}
        assert got == want


def test_trimmed_sections_lead_back_to_their_source(spark):
    lines = ["A one", "T start CUT gone", "x gone too", "N late", "A back", "D end", "more"]
    moves = {"A": (0, 1, 2, 0), "T": (1, 1, 1, 1), "D": (3, 3, 3, 3)}
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, None)], "doc int, page int, body string")
    got = {r.doc: r for r in machines.trimmed(d, ["doc"], "page", "body", F.substring("body", 1, 1), moves, ("keep", "table", "rest", "end"), ("rest", "end"), {"table": ("CUT", "rest")}, "\f").collect()}
    whole, text = "\f".join(lines), got[1].text
    assert text == "A one\fT start\f\n[left out: rest, 38 characters]\n\f\n[left out: end, 9 characters]\n".replace("38", str(len("CUT gone") + len(lines[2]) + len(lines[3]) + len(lines[4]))) and got[1].left_out == 8 + 10 + 6 + 6 + 9
    for s in got[1].segments:
        assert text[s.at : s.at + s.length] == whole[s.source : s.source + s.length]
    assert (got[2].text, got[2].left_out, got[2].segments) == ("", 0, [])


def test_cells_of_sloppy_pages(spark):
    pages = [
        "<table><tr><td>a &lt;b&gt;<td>c<tr><th>d</th>lost<td><a href='/x'>e</a><table><tr><td>in<td>side</table>after</table> <td>no row",
        "</table><TABLE><TBODY><TR><TD>&#x41;&#233;&nbsp;&amp;amp; &unknown; &#0;</TD></TR>",
        "<tr><td>none</td></tr>", "", None, "<!-- <table><tr><td>x -->plain", "<table><td>no row</td><tr></tr><tr><td></td></tr></table>",
    ]
    d = spark.createDataFrame(list(enumerate(pages)), "owner int, html string")
    got = sorted((r.owner, r.parent is not None, r.row, r.cell, r.text, r.href) for r in markup.cells(d, ["owner"], "html").collect())
    assert got == [
        (0, False, 1, 1, "a <b>", None), (0, False, 1, 2, "c", None), (0, False, 2, 1, "d", None), (0, False, 2, 2, "e after", "/x"),
        (0, True, 1, 1, "in", None), (0, True, 1, 2, "side", None), (1, False, 1, 1, "Aé &amp; &unknown; �", None), (6, False, 2, 1, "", None),
    ]


def test_versions_with_notes(spark):
    note = "Same note of this act."
    texts = [(1, 1, f"Text word (note: {note}) ends."), (1, 2, f"Text word1) ends.\n1) {note.upper()}"), (2, 1, "Text one"), (2, 2, "text, ONE!"), (3, 1, "a (note: x)"), (3, 2, "a (note: y)"), (4, 1, None), (5, 1, "1) list\n2) of (things"), (5, 2, "1) list 2) of things")]
    d = spark.createDataFrame(texts, "g int, k int, t string")
    got = {r.g: (r.members, r.considered, r.identities, r.same, r.by_date) for r in versions.compared(d, ["g"], "k", "t", F.lit("s"), F.lit(None).cast("date")).collect()}
    assert got == {1: (2, 2, 1, True, False), 2: (2, 2, 1, True, False), 3: (2, 2, 2, False, False), 4: (1, 1, 1, True, False), 5: (2, 2, 1, True, False)}
    dated = versions.compared(d, ["g"], "k", "t", F.lit("s"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k"))).collect()
    assert all(r.considered == 1 and r.same for r in dated)
    assert not any(r.by_date for r in versions.compared(d, ["g"], "k", "t", F.col("k").cast("string"), F.lit("2024-01-01").cast("date")).collect() if r.members > 1)


def test_first_limitation_of_a_text(spark):
    chain = [inspection.Anchor("head", "ACT", "no head", several="two heads"), inspection.Anchor("day", r" of (\S+)", "no day", kind="date", invalid="bad day", next=True), inspection.Anchor("end", "end", "no end")]
    texts = ["x ACT of 2024-02-03 till end", "ACT x of 2024-02-03 end", "ACT of soon end", "ACT ACT", "none", None, "end ACT of 2024-02-03"]
    d = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, _rest int")
    got = [(r.limitation, str(r.day), r.end) for r in inspection.inspected(d, "t", chain, [("late", F.col("day") > F.lit("2025-01-01").cast("date"))]).orderBy("_rest").collect()]
    assert got == [("", "2024-02-03", "end"), ("no day", "None", None), ("bad day", "None", None), ("two heads", "None", None), ("no head", "None", None), ("no head", "None", None), ("no end", "2024-02-03", None)]


def test_sources_merge_over_hops_with_conflicts(spark):
    rows = [("a:1", "a", "x", 1), ("b:1", "b", None, 2), ("c:1", "c", "z", None), ("a:2", "a", "x", None), ("b:9", "b", "y", 3), ("c:9", "c", "y", 3), ("c:8", "c", "w", 4)]
    links = [("a:1", "b:1"), ("b:1", "c:1"), ("c:9", "b:9"), ("c:8", "b:9"), ("a:2", "b:404"), (None, "a:2"), ("a:2", "a:2")]
    d = spark.createDataFrame(rows, "node string, source string, name string, size int")
    told = merging.identified(d, spark.createDataFrame(links, "left string, right string"))
    got = {r.identity: (r.records, r.name, r.size, r.conflicts) for r in merging.survived(told, ["name", "size"], {"name": ("c", "a"), "size": ("a", "b")}).collect()}
    assert got == {"a:1": (3, "z", 1, ["name", "size"]), "a:2": (1, "x", None, []), "b:9": (3, "w", 3, ["name", "size"])}


def test_splits_keep_groups_whole(spark):
    sizes = [(1, 500), (7, 30), (100, 1), (3, 1)]
    filled, want = [0, 0], {}
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            k = min((0, 1), key=lambda k: (filled[k] / (1.0, 2.0)[k], k))
            filled[k] += size
            want.setdefault(size, [0, 0])[k] += 1
    assert dict(splits.dealt_out(sizes, (1.0, 2.0))) == want
    d = spark.createDataFrame([(i, f"v{i // 5}" if i < 50 else None, f"w{i // 20}" if i < 40 else None) for i in range(200)], "place int, v string, w string").withColumnRenamed("place", "id")
    groups = splits.grouped(d, "id", [F.col("v"), F.col("w")])
    roots = {r.id: r.root for r in groups.collect()}
    assert roots[19] == 0 and roots[39] == 20 and roots[49] == 45 and roots[199] == 199
    out = splits.split(groups, "id", "root", (("tuning", 1.0), ("holdout", 2.0)))
    n = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 200 and abs(n["tuning"] - 200 / 3) <= 20 and splits.leaks(out, ["root"], "split").count() == 0


def test_numbers_along_a_hot_key(spark):
    rows = [("hot" if i % 4 else None if i % 8 else "b", i) for i in range(2000)]
    d = spark.createDataFrame(rows, "_at string, _part int").repartition(7)
    got = {(r._at, r._part): r.n for r in places.numbered(d, "_at", [F.col("_part").desc()], "n").collect()}
    for k in ("hot", None, "b"):
        own = sorted((i for x, i in rows if x == k), reverse=True)
        assert [got[k, i] for i in own] == list(range(len(own)))


@pytest.mark.parametrize("entity,char", [("&#8220;", "“"), ("&#x1F600;", "😀"), ("&sect;", "§"), ("&#xD800;", "�")])
def test_entities(spark, entity, char):
    assert spark.createDataFrame([(f"a{entity}b",)], "t string").select(markup.plain(F.col("t"))).first()[0] == f"a{char}b"


def test_cells_need_no_shuffle_and_follow_the_page(spark):
    lines = "".join(f"<tr><td><a name=x><a href=/{i}>{i}</a><td><table><tr><td>in {i}</table>" for i in range(30_000))
    d = spark.createDataFrame([(1, f"<table>{lines}</table>"), (2, None), (3, "<table><tr><td>é<th>𠀋</table>")], "owner int, html string")
    c = markup.cells(d, ["owner"], "html")
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window"))
    got = c.collect()
    outer = [(r.row, r.cell, r.text, r.href) for r in got if r.owner == 1 and r.parent is None]
    assert outer[:2] == [(1, 1, "0", "/0"), (1, 2, "", None)] and len(outer) == 60_000
    assert sum(r.owner == 1 and r.parent == 0 for r in got) == 0 and sum(r.owner == 1 and r.parent is not None for r in got) == 30_000
    assert [(r.row, r.cell, r.start, r.text) for r in got if r.owner == 3] == [(1, 1, 11, "é"), (1, 2, 16, "𠀋")]
