"""The corpus operators against plain brute force, and on rows with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import decontamination, near_duplicates, near_vectors, packing, private, repeated_passages, secret_scan, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, size int, value int, vector string, shard int"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def odd_rows():
    r = random.Random(4)
    words = ["alpha", "Beta", "gämma", "delta", "<|endoftext|>", "x1", "été", "omega", "don't", "漢字"]
    long = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(20_000))
    shared = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(60))
    texts = [None, "", " \n\t", "one", "One two", "one two", long, long + " end", shared, "before " + shared + " after", shared + " " + shared, "mail a.b@c.org +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.1 300.1.1.1"]
    texts += ["token: " + "a1B2" * 6, "sha " + "0123456789abcdef" * 2, "AKIA" + "Q7" * 8, "zero​width space", "one two"]
    rows = [(i, t, "en", None, None, "id", "node", 1, 2, "v", 3) for i, t in enumerate(texts)]
    rows += [(None, "one two", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), rows[8], rows[8]]
    rows += [(500 + i, "copy of " + shared, "en", "hot", 1, "x", "y", 1, 1, "z", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def split(t):
    return (t or "").encode().split()


def library_ids(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


# -- 1 ---------------------------------------------------------------------------


def naive_coverage(item, doc, least):
    """Greedy string tiling by its definition: the longest match anywhere, again and again."""
    least, a, b, covered = min(least, len(item)), [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(1, least):
            return covered
        a[i : i + n] = b[j : j + n] = [False] * n
        covered += n


def test_tiling_finds_reordered_passages(spark):
    r = random.Random(1)
    docs, items = [], [[r.choice("abcdefgh") + r.choice("xyz") for _ in range(30)] for _ in range(4)]
    for k in range(24):
        x = items[k % 4]
        cut = r.randint(5, 25)
        words = [r.choice("pqrs") for _ in range(20)] + x[cut:] + [r.choice("pqrs")] * r.randint(0, 2) + x[: cut - r.randint(0, 9)]
        docs.append((k, " ".join(words)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    want = {(k, i): naive_coverage(x, t.split(), 5) for k, t in docs for i, x in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 15}
    got = {(p.doc_id, p.item_id): p.covered_words for p in decontamination.contaminated_pairs(d, b).collect()}
    assert got == want and len(want) >= 12
    assert {x.doc_id for x in decontamination.decontaminated(d, b).collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_tiles_are_the_greedy_ones():
    r = random.Random(5)
    cases = [([*range(1, 25)], [*range(1, 13), 0, *range(9, 21), 0, *range(18, 25)])]
    for _ in range(600):
        letters = range(1, r.choice((3, 4, 8)))
        cases.append(([r.choice(letters) for _ in range(r.randint(1, 30))], [r.choice((0, *letters)) for _ in range(r.randint(0, 40))]))
    for item, doc in cases:
        for least in (2, 5):
            tiles = decontamination.greedy_tiles(item, doc, least)
            assert sum(n for _, _, n in tiles) == naive_coverage(item, [x or -1 for x in doc], least)
            assert all(item[i : i + n] == doc[j : j + n] for i, j, n in tiles)


def test_decontamination_of_odd_rows(spark, odd, empty):
    shared = odd_rows()[8][1]
    b = spark.createDataFrame([(1, shared, 0), (1, shared, 1), (None, "copy of", 2), (3, None, 3), (4, "", 4), (5, "nowhere to be found at all", 5)], "item_id long, text string, doc_id int")
    found = {(p.doc_id, p.item_id) for p in decontamination.contaminated_pairs(odd, b).collect()}
    has = [i for i, t, *_ in odd_rows() if t and shared in t]
    assert found == {(i, 1) for i in has} | {(500 + i, None) for i in range(40)}
    kept = decontamination.decontaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - len(has)
    assert decontamination.contaminated_pairs(empty, b).count() == 0 and decontamination.contaminated_pairs(odd, b.limit(0)).count() == 0
    assert bag(decontamination.decontaminated(odd, b.limit(0)).collect()) == bag(odd.collect())


def test_benchmark_in_blocks_finds_the_same(spark, monkeypatch):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = bag(decontamination.contaminated_pairs(d, b).collect())
    monkeypatch.setattr(decontamination.blocks, "__defaults__", ("text", 1500))
    assert bag(decontamination.contaminated_pairs(d, b).collect()) == whole and whole


# -- 2, 6 ------------------------------------------------------------------------


def base_private(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        n = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(n) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(n)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@pytest.mark.parametrize(("find", "base"), [(private.personal_data, base_private), (secret_scan.secrets, base_secrets)])
def test_rule_spans_equal_plain_regexes(spark, odd, empty, find, base):
    assert find(empty).count() == 0
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (d, t), n in texts.items():
        want[d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t or "")).encode()).hexdigest()] += n
    got = find(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[d].append(base(t or ""))
    for r in got:
        assert any({f"{k}:{a}:{b}" for k, a, b in s} <= set(r.spans.split(",")) | ({""} if not s else set()) for s in by_id[r.doc_id])


def test_email_rules_on_hard_texts():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("a1.@@-+ ") for _ in range(r.randint(0, 24)))
        assert private.rule_spans(t)["email"] == [b[1:] for b in base_private(t) if b[0] == "email"]


def test_the_tagger_finds_loose_forms_and_its_gradient_is_right():
    m = private.default_tagger()
    cases = private.labelled_spans(300, seed=99)
    found = private.model_spans(m, [t for t, _ in cases])
    hits = sum(s in f for (_, spans), f in zip(cases, found, strict=True) for s in spans)
    total, made = sum(len(s) for _, s in cases), sum(map(len, found))
    assert hits / total > 0.7 and hits / made > 0.8
    m = private.CharTagger(4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = np.random.default_rng(0).integers(0, private.N_SYMBOLS, (6, 2)), np.random.default_rng(1).integers(0, len(private.TAGS), (6, 2))
    _, g = m.loss(x, y)
    for k in ("uf", "ob", "move"):
        at, e = tuple(0 for _ in m.p[k].shape), 1e-3
        m.p[k][at] += e
        up, _ = m.loss(x, y)
        m.p[k][at] -= 2 * e
        down, _ = m.loss(x, y)
        m.p[k][at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-2 * max(1, abs(g[k][at]))


def test_overlapping_windows_are_reconciled():
    assert private.reconciled([(0, 0, 5, 1.0), (1, 3, 9, 3.0), (0, 9, 12, 1.0)]) == [(1, 3, 9), (0, 9, 12)]
    long = "word " * 40 + "call 555-010-9999 now " + "word " * 40
    assert len(private.all_spans(private.default_tagger(), [long])[0][1]) <= 1


class DigitTagger:
    """Tags every run of digits or at signs as a phone number."""

    def decode(self, x):
        n, k = len(private.SYMBOLS), 1 + 2 * private.KINDS.index("phone")
        hit = ((x == n) | (x == private.SYMBOLS.index("@"))).T
        first = hit.copy()
        first[1:] &= ~hit[:-1]
        return np.where(first, k, np.where(hit, k + 1, 0)), hit * 1.0


def test_no_span_is_lost_between_windows():
    """Spans of every length at every offset are found once and whole."""
    for length in [*range(9, 200), 255, 256, 257, 400, 1000]:
        texts = ["x" * (200 + o) + "5" * length + "x" * 300 for o in range(64)]
        assert private.model_spans(DigitTagger(), texts) == [[("phone", 200 + o, 200 + o + length)] for o in range(64)], length
    loose = sorted({t[a:b] for t, spans in private.labelled_spans(3000, seed=99) for k, a, b in spans if k == "email" and not private.rule_spans(t[a:b])["email"]}, key=lambda x: (-len(x), x))[:12]
    pad = "lorem ipsum dolor sit amet " * 14
    texts = [(len(pad[: 200 + o]) + 1, x, f"{pad[: 200 + o]} {x} {pad[:220]}") for x in loose for o in range(64)]
    found = private.model_spans(private.default_tagger(), [t for _, _, t in texts])
    hits = [sum(k == "email" and a < at + len(x) and b > at for k, a, b in f) for (at, x, _), f in zip(texts, found, strict=True)]
    # the model itself may miss some; narrow windows lost another tenth
    assert max(hits) == 1 and np.mean(hits) > 0.95


def test_windows_without_a_mark_hold_no_span(monkeypatch):
    """A span needs a digit or an at sign, so decoding every window finds the same ones."""
    cases = private.labelled_spans(300, seed=5)
    texts = ["".join(t + " " + "plain words of a longer text, " * (i % 11) for t, _ in cases[i : i + 4]) for i in range(0, 300, 4)]
    some = private.model_spans(private.default_tagger(), texts)
    monkeypatch.setattr(private, "MARK", re.compile(".", re.S))
    assert private.model_spans(private.default_tagger(), texts) == some and sum(map(len, some)) > 100


def test_redaction_leaves_no_rule_span(odd, empty):
    assert private.redacted(empty).count() == 0
    out = private.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert not any(base_private(r.text or "") for r in out.collect())


def test_entropy_is_kept_up_to_date():
    run = "".join(random.Random(3).choice("abcdefgh0123") for _ in range(80))
    for i, bits in enumerate(secret_scan.entropies(run)):
        c = Counter(run[i : i + secret_scan.WINDOW]).values()
        assert abs(bits + sum(n / secret_scan.WINDOW * math.log2(n / secret_scan.WINDOW) for n in c)) < 1e-9
    assert secret_scan.entropy_spans("key Zx8Qw3LmN0pRt5VbYk2JhG7d end") and not secret_scan.entropy_spans("some/path/to/a/file and 123e4567-e89b-12d3-a456-426614174000 and averyveryverylongword")


# -- 3, 8, 10 ----------------------------------------------------------------------


def test_token_counts_equal_the_library(odd, empty):
    assert token_counts.token_counts(empty, WORD_BPE).count() == 0
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library_ids(WORD_BPE, r.text, 0)) - 1, n > 2048) for r in odd.collect())
    assert bag(token_counts.token_counts(odd, WORD_BPE).collect()) == want


def test_batches_hold_about_equal_bytes():
    sizes = [random.Random(5).randint(1, 1000) for _ in range(500)]
    loads = [sum(sizes[i] for i in b) for b in token_counts.byte_batches(sizes, 10_000)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) <= 1000


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    assert token_files.token_file_round_trip(empty, BYTE_BPE).count() == 0
    got = sorted(token_files.token_file_round_trip(odd, BYTE_BPE).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array(library_ids(BYTE_BPE, t, 2), "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r.doc_id, crc(r.text)) for r in odd.collect())
    # ties: documents of one id stand in the same order, however the rows are dealt
    again = sorted(token_files.token_file_round_trip(odd.repartition(7, "n_chars"), BYTE_BPE).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
    token_files.write_token_files(odd, str(tmp_path / "f"), BYTE_BPE)
    one = token_files.read_token_files(spark, str(tmp_path / "f")).where("doc_id = 5")
    assert [list(r.ids) for r in one.collect()] == [library_ids(BYTE_BPE, "one two", 2)]


def test_a_frequent_id_fills_several_token_files_and_the_order_holds():
    bounds = np.array([token_files.NO_ID, token_files.NO_ID, 5, 9, 9, 9], np.int64)
    r = np.random.default_rng(0)
    ids, keys = r.choice(np.array([token_files.NO_ID, 1, 5, 7, 9, 12]), 5000), r.integers(-(2**63), 2**63 - 1, 5000)
    shard = token_files.shards(bounds, ids, keys)
    order = np.lexsort([keys, ids])
    assert (np.diff(shard[order]) >= 0).all() and len(set(shard[ids == 9])) == 4 and len(set(shard[ids == token_files.NO_ID])) == 3
    assert shard.min() == 0 and shard.max() == 6


def scanned_rows(df):
    """Rows that the file scans of ``df`` gave out in a run."""
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    found, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName() or "QueryStage" in node.nodeName():
            todo.append(node.executedPlan() if "Adaptive" in node.nodeName() else node.plan())
        elif node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text")
    token_files.write_token_files(docs, str(tmp_path / "g"), BYTE_BPE, files=2)
    rows = spark.read.schema(token_files.SCHEMA).orc(str(tmp_path / "g/ids"))
    assert scanned_rows(rows.where("doc_id = 30000").select("ids")) <= 1000
    # between two ids, within every range: only the Bloom filter can tell
    assert scanned_rows(rows.where("doc_id = 30001").select("ids")) == 0
    assert scanned_rows(rows.select("ids")) == 20_000


def test_packing_covers_every_id_once(odd, empty):
    assert packing.pack_documents(empty, WORD_BPE).count() == 0
    docs = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    ids = {r.doc_id: library_ids(WORD_BPE, r.text, 1) for r in docs.collect()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, WORD_BPE).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts, sizes in ((pieces, {d: len(x) for d, x in ids.items()}), (seqs, None)):
        for k, p in parts.items():
            at = 0
            for a, n in sorted(p):
                assert a == at
                at += n
            assert at == sizes[k] if sizes else at <= 2048
    short = [n for n in (sum(x[1] for x in p) for p in seqs.values()) if n & (n - 1)]
    assert len(short) <= docs.rdd.getNumPartitions() * 2
    assert packing.pack_documents(odd, WORD_BPE).agg(F.sum("length")).first()[0] == sum(len(library_ids(WORD_BPE, r.text, 1)) for r in odd.collect())


@pytest.mark.parametrize("buffer", [20_000, 2_000_000])
def test_step_groups_hold_as_many_ids(odd, monkeypatch, buffer):
    monkeypatch.setattr(packing, "BUFFER_IDS", buffer)
    rows = packing.pack_documents(odd, WORD_BPE, step_ids=4096).collect()
    windows = {r.sequence_id: (r.step_group, r.window) for r in rows}
    groups = Counter()
    for group, window in windows.values():
        groups[group] += window
    # only the last group of all may be short, however many tasks there are
    assert len(groups) > 10 and all(n == 4096 for g, n in groups.items() if g != max(groups)) and groups[max(groups)] <= 4096
    assert all(g < packing.LEFT or g - packing.LEFT < odd.rdd.getNumPartitions() for g in groups)
    # a sequence fills its window, but for the last one of a task
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sum(filled[s] != w for s, (_, w) in windows.items()) <= odd.rdd.getNumPartitions()
    assert sum(filled.values()) == sum(len(library_ids(WORD_BPE, r.text, 1)) for r in odd.collect())


# -- 4 -----------------------------------------------------------------------------


@pytest.mark.parametrize(("hot", "most"), [(20_000, 500_000), (1, 500_000), (1, 0), (3, 500_000)])
def test_repeated_windows_equal_a_plain_count(odd, empty, monkeypatch, hot, most):
    # nothing hot, a broadcast of the hot ones, salted keys, hot and other minimisers together
    monkeypatch.setattr(repeated_passages, "MOST_HOT", most)
    assert repeated_passages.without_repeats(empty, digest=True).count() == 0
    rows = odd.collect()
    counts = Counter(tuple(w[i : i + 35]) for w in (split(r.text) for r in rows) for i in range(len(w) - 34))
    want = Counter()
    for r in rows:
        w = split(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[r.doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert bag(repeated_passages.without_repeats(odd, hot=hot, digest=True).collect()) == want


# -- 5 -----------------------------------------------------------------------------


def test_the_machine_learns_what_no_sum_of_weights_can():
    r = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(800):
        a, b = r.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([r.integers(100, 130, 5), [10 + a, 20 + b]])))
        y.append(float(a == b))
    m = toxicity.FactorizationMachine.fit(rows[:600], np.array(y[:600]), epochs=60, l1=1e-4)
    assert ((m.scores(rows[600:]) >= 0.5) == np.array(y[600:])).mean() > 0.9


def test_scores_equal_the_formula_over_explicit_pairs():
    r = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(-0.3, np.zeros(toxicity.BUCKETS), np.zeros((toxicity.BUCKETS, 3)))
    m.weights[:40], m.factors[:30] = r.normal(size=40), r.normal(size=(30, 3))
    rows = [np.sort(r.choice(60, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    for row, score in zip(rows, m.scores(rows), strict=True):
        raw = m.bias + sum(m.weights[i] for i in row) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(row) for j in row[k + 1 :])
        assert math.isclose(score, 1 / (1 + math.exp(-raw)), rel_tol=1e-9)


def test_toxicity_of_repeated_null_and_very_long_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    odd_labels = labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int"))
    once, twice = (toxicity.fit_toxicity(base, x) for x in (labels, odd_labels))
    assert once.bias == twice.bias and (once.weights == twice.weights).all() and (once.factors == twice.factors).all()
    texts = [(1, "x " * 200_000), (1, "x"), (None, None), (None, "")]
    rows = toxicity.toxicity_scores(spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit(7)).withColumn("y", F.lit(1)), labels).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(rows) == 4 and scores[1][0] == scores[1][1] and scores[None][0] == scores[None][1]


def test_toxicity_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.6 and sum(clean) / len(clean) < 0.01
    none = labels.limit(0)
    assert max(r.score for r in toxicity.toxicity_scores(odd, none).collect()) < 1e-6
    assert toxicity.toxicity_scores(empty, none).count() == 0 and toxicity.not_toxic(odd, none).count() == odd.count()


def test_the_cap_does_not_change_the_mix(spark):
    """Fitted on as many clean as toxic rows, scores still hold for the mix of all; repeated ids are fitted once."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    n = labels.where((F.col("toxic") == 1) & ~toxicity.held_out(F.col("doc_id"))).count()
    m = toxicity.fit_toxicity(docs, labels, most=n)
    table = toxicity._Terms()
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    score = m.scores([toxicity.terms(r.text or "", table) for r in rows])
    y = np.array([r.toxic for r in rows])
    print("false positives", (score[y == 0] >= 0.5).mean(), "recall", (score[y == 1] >= 0.5).mean())
    assert (score[y == 0] >= 0.5).mean() < 0.005 and (score[y == 1] >= 0.5).mean() > 0.6
    few, tags = docs.limit(300), labels.limit(300)
    one, two = (toxicity.fit_toxicity(d, tags) for d in (few, few.union(few)))
    assert one.bias == two.bias and (one.weights == two.weights).all()


# -- 7 -----------------------------------------------------------------------------


def link_matrix(vectors):
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    return links


def vector_rows():
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 24))
    near = np.repeat(base[:40], 3, 0) + r.normal(size=(120, 24)) * r.uniform(0.05, 0.5, (120, 1))
    return [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([base, near, np.repeat(base[:1], 60, 0), base[5:6] * 3]))]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_equal_brute_force(spark, kind):
    rows = vector_rows()
    bad = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] + [1.0] * 23), (9003, [None] + [1.0] * 23), (9004, [float("inf")] * 24), (9005, [1.0]), (9006, [])]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors.near_vectors(spark.createDataFrame(rows + bad, f"vec_id long, embedding array<{kind}>")).collect()}
    links = link_matrix([v for _, v in rows])
    found = sum(got[i][0] for i, _ in rows)
    assert found >= 0.98 * links.sum() and all(got[i][0] <= links[i].sum() for i, _ in rows)
    assert all(got[k] == (0, k, True) for k, _ in bad)
    assert got[330 - 60][1] == 0 and not got[275][2]
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("per_list, first, block", [(8, 1024, 1024), (8, 6, 1024), (400, 1024, 16)])
def test_near_vectors_over_many_lists_levels_and_blocks(spark, monkeypatch, per_list, first, block):
    for name, value in (("LIST", per_list), ("BLOCK", block), ("PORTION", 2 * block)):
        monkeypatch.setattr(near_vectors, name, value)
    fit = near_vectors.Quantiser.fit.__func__
    monkeypatch.setattr(near_vectors.Quantiser, "fit", classmethod(lambda cls, x, lists: fit(cls, x, lists, first=first)))
    rows = vector_rows()
    links = link_matrix([v for _, v in rows])
    got = {x.vec_id: x for x in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = sum(got[i].n_links for i, _ in rows)
    assert 0.98 * links.sum() <= found <= links.sum() and all(got[i].n_links <= links[i].sum() for i, _ in rows)


def test_near_vectors_of_other_lengths_null_and_repeated_ids_and_odd_columns(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, [1.0, 0.01], "b"), (None, [0.0, 1.0, 0.0], "c"), (None, [0.01, 1.0, 0.0], "d"), (7, [0.0, 1.0, 0.0], "e"), (7, [1.0, 0.0, 0.0], "f")] + [(100 + i, [float(i == j) for j in range(9)], "g") for i in range(9)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").withColumn("node", F.lit(1)).withColumn("vector", F.lit("x"))).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(
        [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (7, 0, 7, True)] + [(100 + i, 0, 100 + i, True) for i in range(9)]
    )
    # a length that the sample doesn't hold is compared as one list
    assert [len(np.unique(near_vectors.Quantiser.single(3).encode(np.eye(3))[0])), len(near_vectors.Quantiser.single(3).probes(np.eye(3), 0.9)[0])] == [1, 3]


# -- 9 -----------------------------------------------------------------------------


def brute_components(rows, width, percent):
    """(id, set size, component id) of (id, text) rows by comparing all pairs."""
    sets, words = [], [t.split() for t in ((t or "").encode().lower() for _, t in rows)]
    for w in words:
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                own[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd, empty, width):
    r = random.Random(8)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    near = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 10 ** 6)}"
        near.append((1000 + k, " ".join(w)))
    docs = odd.select("doc_id", "text", "node", "size", "value").union(spark.createDataFrame([(d, t, None, None, None) for d, t in near], "doc_id long, text string, node string, size int, value int"))
    want = Counter((d, n, c, d == c) for d, n, c in brute_components([(x.doc_id, x.text) for x in docs.collect()], width, 80))
    assert bag(near_duplicates.near_duplicates(docs, width).collect()) == want
    assert near_duplicates.near_duplicates(empty, width).count() == 0


def test_blocks_compare_every_pair(spark, odd, monkeypatch):
    """Without rounds of stars, and with tiny blocks, the same links are found."""
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    monkeypatch.setattr(near_duplicates, "TILE", 2)
    monkeypatch.setattr(near_duplicates, "FEW", 4)
    want = Counter((d, n, c, d == c) for d, n, c in brute_components([(x.doc_id, x.text) for x in odd.collect()], 2, 80))
    assert bag(near_duplicates.near_duplicates(odd, 2).collect()) == want


def test_one_row_of_each_component_stays(spark, odd, empty):
    """Null, repeated and identical ids: rows are judged one by one."""
    assert near_duplicates.one_of_each(empty).count() == 0
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (None, a, "x"), (None, b, "x"), (5, a, "x"), (5, c, "x"), (7, d, "x"), (7, d, "x"), (7, d, "y"), (None, b, "x"), (None, b + " end", "x"), (3, " ", "x"), (3, " ", "x"), (None, None, "x")]
    got = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    kept = Counter((r.doc_id, r.text) for r in got)
    assert kept.pop((None, b), 0) + kept.pop((None, b + " end"), 0) == 1
    assert kept == {(1, a): 1, (5, c): 1, (7, d): 1, (3, " "): 2, (None, None): 1}
    out = near_duplicates.one_of_each(odd)
    texts = [(x.doc_id, x.text) for x in out.collect()]
    assert out.columns == odd.columns and len(texts) == len(set(texts)) + sum(1 for x in odd.collect() if not (x.text or "").split()) - len({t for t in texts if not (t[1] or "").split()})


# -- the pipeline ------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, decontamination.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in out.collect()} if name != "packing" else {}
        texts = {r.doc_id: r.text for r in before}
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert set(after) == {d for d, n, c in brute_components(list(texts.items()), 5, 80) if c == d}
        elif name == "decontamination":
            gone = {d for d, t in texts.items() for _, x in items if len(set(x) & set(decontamination.words(t))) * 2 >= len(set(x)) / 2 and naive_seeded(x, decontamination.words(t))}
            assert set(after) == set(texts) - gone and gone
        elif name == "pii":
            assert set(after) == set(texts) and not any(base_private(t) for t in after.values())
        elif name == "packing":
            assert {r.doc_id for r in out.collect()} == set(texts)
        docs = out


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline
    from gristmill.llm.common import stored

    for docs, rows in ((odd, odd.count()), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF), f"odd-{name}")
            if name == "packing":
                assert out.agg(F.sum("length")).first()[0] == (sum(len(library_ids(WORD_BPE, r.text, 1)) for r in docs.collect()) or None)
                continue
            assert out.columns == docs.columns and (rows > 0) == (out.count() > 0)
            blank = lambda d: bag(d.where("trim(coalesce(text, '')) = ''").collect())
            assert blank(out) == blank(docs)
            if name == "near_dedup":
                assert set(bag(out.collect()).values()) <= {1} or blank(out)
            docs = out


def naive_seeded(item, doc):
    """Whether tiles cover half of the item; documents without a shared seed can't, and are told at once."""
    seeds = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
    at = [j for j in range(len(doc) - 4) if tuple(doc[j : j + 5]) in seeds]
    if not at:
        return False
    near = sorted({k for j in at for k in range(max(0, j - 1), min(len(doc), j + 6))})
    return 2 * naive_coverage(item, [doc[k] if i == 0 or near[i - 1] == k - 1 else "\0" + doc[k] for i, k in enumerate(near)], 5) >= len(item)
