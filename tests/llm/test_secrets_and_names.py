"""Entropy spans against windows counted one by one, very long texts, and columns that are named like helpers."""

import math
import random
import time
from collections import Counter

from gristmill.llm import near_duplicates, secret_scan


def brute_entropy_spans(text):
    """Every window counted by itself; touching windows are joined, what a rule's span overlaps goes."""
    width, found = secret_scan.WINDOW, []
    for m in secret_scan.CANDIDATE.finditer(text):
        run = m[0]
        if any(p.match(run) for p in secret_scan.ALLOW):
            continue
        kind = next(k for k, p in secret_scan.CLASSES if p.match(run))
        high = [i for i in range(len(run) - width + 1) if -sum(n / width * math.log2(n / width) for n in Counter(run[i : i + width]).values()) >= secret_scan.THRESHOLDS[kind] - 1e-12]
        spans = []
        for i in high:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + width
            else:
                spans.append([i, i + width])
        found += [(m.start() + a, m.start() + b) for a, b in spans]
    held = [s for spans in secret_scan.rule_spans(text).values() for s in spans]
    return [(a, b) for a, b in found if all(b <= x or a >= y for x, y in held)]


def test_entropy_spans_are_those_of_all_windows():
    r = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 6)):
            letters = r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123456789", "abcxyz01", "A1b2C3+/=_-9Z8y7X"])
            parts.append(r.choice(["", "token=", "AKIA", "password: "]) + "".join(r.choice(letters) for _ in range(r.randint(10, 90))))
        text = r.choice([" ", "\n", "; "]).join(parts)
        got = [(a, b) for k, a, b in secret_scan.secret_spans(text)[1] if k == "entropy"]
        assert got == brute_entropy_spans(text)


def test_a_dump_of_many_secrets_takes_seconds():
    r = random.Random(4)
    one = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(24))
    text = "\n".join(f"token = {one()} {one()}" for _ in range(50_000))
    start = time.process_time()
    base, spans = secret_scan.secret_spans(text)
    assert len(base["assign"]) == 50_000 and sum(k == "entropy" for k, *_ in spans) > 40_000
    assert time.process_time() - start < 60


def test_one_of_each_keeps_columns_named_like_helpers(spark):
    names = ["_key", "_id", "_text", "_t", "_i", "_several", "row", "own_id", "own_key", "kept_id", "kept_key", "several", "node", "digest"]
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, *[f"{n}1" for n in names]), (2, long + " end", *[f"{n}2" for n in names]), (3, "", *[f"{n}3" for n in names]), (None, "other words of one text here", *[f"{n}4" for n in names]), (1, long, *[f"{n}5" for n in names])]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = near_duplicates.one_of_each(d)
    assert out.columns == d.columns
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, long), (3, ""), (None, "other words of one text here")} and len(got) == 3
    for r in got:
        ends = {r[n][len(n) :] for n in names}
        assert len(ends) == 1 and ends <= {"1", "3", "4", "5"}
