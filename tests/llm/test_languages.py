"""Language identification against Kneser-Ney written with dictionaries, on held-out rows, and on odd texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import languages, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram long, context string, h int, n string, bits int"


def symbols(text):
    """Letters in lower case, other characters as one space, after the start."""
    found = []
    for c in text or "":
        if c.isalpha():
            found.append(ord(c.lower()[0]))
        elif found and found[-1] != 0:
            found.append(0)
    return [1, 1, 1, *found]


def brute_models(rows):
    models, alphabet = {}, set()
    for lang in {x for x, _ in rows}:
        counts = Counter()
        for x, t in rows:
            s = symbols(t)
            if x == lang:
                counts.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        orders = []
        for _ in range(4):
            n = Counter(counts.values())
            d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            totals, kinds = defaultdict(int), defaultdict(int)
            for g, c in counts.items():
                totals[g[:-1]] += c
                kinds[g[:-1]] += 1
            orders.insert(0, (counts, d, totals, kinds))
            counts = Counter(g[1:] for g in counts)
        alphabet |= set(orders[0][0])
        models[lang] = orders
    return models, 2 + len(alphabet)


def brute_entropy(orders, size, text):
    s, bits = symbols(text), 0.0
    for i in range(3, len(s)):
        p = 1 / size
        for k, (counts, d, totals, kinds) in enumerate(orders, 1):
            g = tuple(s[i - k + 1 : i + 1])
            if totals[g[:-1]]:
                p = max(counts[g] - d, 0) / totals[g[:-1]] + d * kinds[g[:-1]] / totals[g[:-1]] * p
        bits -= math.log2(p)
    return bits / max(1, len(s) - 3)


def test_models_are_kneser_ney(spark):
    r = random.Random(1)
    rows = [(x, " ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 40)))) for x, a in (("en", "abcde E,"), ("fr", "aéèbç.d"), ("zh", "漢字𠀋abc")) for _ in range(30)]
    rows.append(("en", None))
    models = languages.fit_models(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    plain, size = brute_models(rows)
    texts = [t for _, t in rows if t] + ["zebra!", "", "É  é--漢字 xyz", "a" * 50, "\0\0 a\ud800b"[:4]]
    bits, sizes, letter = models.entropies(texts)
    for t, b, n, known in zip(texts, bits, sizes, letter):
        assert n == len(symbols(t)) - 3 and known == any(c.isalpha() for c in t)
        for lang, x in zip(models.langs, b):
            if "𠀋" not in t:
                assert x == pytest.approx(brute_entropy(plain[lang], size, t), rel=1e-4, abs=1e-6)


def test_cut_texts_count_as_whole_ones(spark, monkeypatch):
    texts = ["ab  cd. EF", "", "x", "  lead and trail  ", "word " * 40]
    whole = [languages.Grams().of([t], [(0, 0, len(t))])[0].tolist() for t in texts]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(languages, "PIECE", size)
        grams, found = languages.Grams(), defaultdict(list)
        for batch in languages.pieces(texts):
            packed, owner, _ = grams.of(texts, batch)
            for p, o in zip(packed.tolist(), owner.tolist()):
                found[batch[o][0]].append(p)
        assert [found[i] for i in range(len(texts))] == whole


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_language_id"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(docs.keys())
    langs = {d.lang for d in docs.values()}
    right = Counter()
    for r in got:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in langs
            right[r.held_out, r.lang_pred == d.lang] += 1
    assert right[True, True] >= 0.97 * (right[True, True] + right[True, False])
    assert sum(r.rejected for r in got) <= 0.05 * len(got)


def test_held_out_rows_teach_nothing_and_odd_rows_have_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = languages.fit_languages(docs)
    changed = docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("qqq")).otherwise(F.col("text")))
    again = languages.fit_languages(changed.withColumn("lang", F.when(F.col("text") == "qqq", F.lit("xx")).otherwise(F.col("lang"))))
    assert again.models.langs == fitted.models.langs and np.array_equal(again.models.logs, fitted.models.logs)
    rows = [(1, None), (2, ""), (3, " 12 \n"), (None, "the thing and that other"), (4, "漢字漢字漢字漢字漢字漢字漢字"), (5, "the " * 600_000), (6, "der die"), (6, "der die"), (7, "Ⅷ ٣")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1, 1, "c", 1, "n", 1) for i, t in rows], SCHEMA)
    got = languages.language_ids(odd, fitted).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3, 7))
    assert by[None].lang_pred == "en" and by[4].rejected and by[4].lang_pred == "und" and by[6].lang_pred == "de"
    assert languages.language_ids(odd.limit(0), fitted).count() == 0
    nothing = languages.language_ids(odd, languages.fit_languages(odd.where("false")), reject=False).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_grams_beyond_the_limit_are_joined(spark):
    r = random.Random(3)
    rows = [(x, " ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 40)))) for x, a in (("en", "abcde E,"), ("fr", "aéèbç.d"), ("zh", "漢字abc")) for _ in range(20)]
    plain, size = brute_models(rows)
    texts = [*[t for _, t in rows], "zebra!", "", None, "É  é--漢字 xyz", "a" * 50, "xyz " * 9, "3 4"]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    asked = spark.createDataFrame([(None if i == 4 else i // 2, i, t) for i, t in enumerate(texts)], "doc_id long, i int, text string")
    for cells in (0, 30, 1000):
        models = languages.fit_models(d, cells)
        assert models.tables and models.symbols == size and len(models.known) == cells // 3
        got = languages.text_bits(asked.repartition(2).select("doc_id", "i", "text"), models).collect()
        assert sorted(x.i for x in got) == list(range(len(texts)))
        for x in got:
            assert x.doc_id == (None if x.i == 4 else x.i // 2) and x.n == len(symbols(texts[x.i])) - 3 and x.letter == any(c.isalpha() for c in texts[x.i] or "")
            for lang, bits in zip(models.langs, x.bits):
                assert bits == pytest.approx(brute_entropy(plain[lang], size, texts[x.i]), rel=1e-4, abs=1e-6)


def test_the_limit_changes_no_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    whole = {r.doc_id: r for r in languages.language_ids(docs).collect()}
    fitted = languages.fit_languages(docs, most_cells=400)
    assert fitted.models.tables
    got = languages.language_ids(docs, fitted).collect()
    assert len(got) == len(whole)
    for r in got:
        w = whole[r.doc_id]
        assert (r.lang_pred, r.rejected) == (w.lang_pred, w.rejected) and r.score == pytest.approx(w.score, rel=1e-5)
