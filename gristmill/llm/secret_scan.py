"""Secrets in texts: rules, and windows of high entropy besides.

The rules find assigned passwords and tokens, access keys and long hex strings.
Beyond them every run of key characters is a candidate. Its characters are of a
class (hex digits, letters and digits, base64); a window slides over the run
while counts of its characters, and with them the Shannon entropy, are brought
forward by one character in and one out. Windows over the class's threshold
are joined to a span of kind ``entropy``. Words, identifiers without digits,
UUIDs, paths and dotted names are on the allow-list, and spans that touch one of
the rules' are dropped. Offsets are code points, ends exclusive.

Null texts are empty; null or repeated doc_ids are rows like any other, other
columns are left out, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame

from gristmill.llm.common import per_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# runs are greedy, so a least length in the pattern drops the same matches as a test afterwards
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

WINDOW = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Bits a character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.8}
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+\Z")), ("alnum", re.compile(r"[0-9A-Za-z]+\Z")), ("base64", re.compile(r".+\Z")))
ALLOW = (
    re.compile(r"[A-Za-z/_=+-]+\Z"),
    re.compile(r"[0-9/_=+-]+\Z"),
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z"),
    re.compile(r"/?([A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}\Z"),
    re.compile(r"[A-Za-z]+([_-][A-Za-z]*[0-9]{0,4})+\Z"),
)


def rule_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def entropies(run: str, width: int = WINDOW) -> list[float]:
    """Shannon entropy in bits of each window of ``run``, from counts kept up to date.

    The entropy of a window is log2(width) less the mean of n * log2(n) over its
    characters' counts n; a step changes two counts.
    """
    part = [0.0, *(n * log2(n) for n in range(1, width + 1))]
    counts = Counter(run[:width])
    total = sum(part[n] for n in counts.values())
    out = [log2(width) - total / width]
    for gone, come in zip(run, run[width:], strict=False):
        n = counts[gone]
        total += part[n - 1] - part[n]
        counts[gone] = n - 1
        n = counts[come]
        total += part[n + 1] - part[n]
        counts[come] = n + 1
        out.append(log2(width) - total / width)
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(p.match(run) for p in ALLOW):
            continue
        least = THRESHOLDS[next(k for k, p in CLASSES if p.match(run))]
        start = end = -1
        for i, bits in enumerate(entropies(run)):
            if bits < least:
                continue
            if i > end:
                if end > 0:
                    out.append((m.start() + start, m.start() + end))
                start = i
            end = i + WINDOW
        if end > 0:
            out.append((m.start() + start, m.start() + end))
    return out


def secret_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Spans of the rules by kind; all spans (kind, start, end) by start, then kind."""
    base = rule_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    # the furthest end of all rule spans up to each start tells whether one reaches into a span
    held = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in held], [0, *accumulate((b for _, b in held), max)]
    spans += [("entropy", a, b) for a, b in entropy_spans(text) if ends[bisect_left(starts, b)] <= a]
    order = {k: i for i, k in enumerate((*KINDS, "entropy"))}
    return base, sorted(spans, key=lambda s: (s[1], order[s[0]]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by the rules, their digest, and all spans."""

    def make():
        def work(ids, texts):
            out = []
            for d, text in zip(ids, texts, strict=True):
                base, spans = secret_spans(text)
                digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "entropy").encode()).hexdigest()
                out.append((d, *(len(base[k]) for k in KINDS), digest, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
            return out

        return work

    return per_text(docs, id_col, text_col, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
