"""Personal data in texts: rules first, then a character model for what rules miss.

The rules find e-mail addresses, IP addresses, card and phone numbers in their
plain forms. A bidirectional LSTM with CRF transitions over characters, trained
in numpy from labelled spans, adds forms the rules don't describe (a phone
number without its plus sign, a card with dots, an address with a spaced or
bracketed at sign).

The model reads overlapping windows. A span of any kind holds a digit or an at
sign, so a window with neither is only run where a span of its neighbour goes on
in it. Each window decodes its best tag sequence. Spans of up to ``WHOLE``
characters lie whole in some window at any offset; longer ones are stitched from
the pieces of neighbouring windows. Over the whole text the best-scoring set of
spans that don't overlap is kept. Spans of the rules always stay, and model spans that touch one
are dropped. Offsets are code points, ends exclusive.

Null texts are empty and hold nothing; null or repeated doc_ids are rows like
any other, other columns are left out, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gristmill.llm.common import per_row, per_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WINDOW, STRIDE = 192, 64
#: The longest span that some window holds with a character to spare on both sides.
WHOLE = WINDOW - STRIDE - 1
#: Characters of a labelled case to learn from.
CASE = 96
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the rules by kind, leftmost and not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out["email"].append((start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 2000) and all(len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# -- the character model ------------------------------------------------------

SYMBOLS = " \n.,:;@+-()_%/[]#"


def _codes() -> np.ndarray:
    """The symbol of each code point below 256; others share one."""
    table = np.full(257, len(SYMBOLS) + 5, np.int64)
    for c in range(256):
        ch = chr(c)
        if ch in SYMBOLS:
            table[c] = SYMBOLS.index(ch)
        elif "0" <= ch <= "9":
            table[c] = len(SYMBOLS)
        elif "a" <= ch <= "z":
            table[c] = len(SYMBOLS) + 1
        elif "A" <= ch <= "Z":
            table[c] = len(SYMBOLS) + 2
        elif ch.isalpha():
            table[c] = len(SYMBOLS) + 3
        else:
            table[c] = len(SYMBOLS) + 4
    return table


CODES = _codes()
N_SYMBOLS = len(SYMBOLS) + 6


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODES[np.minimum(points, 256)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class CharTagger:
    """Bidirectional LSTM over symbols, linear scores of tags, CRF transitions."""

    def __init__(self, hidden: int = 20, seed: int = 7):
        r, t = np.random.default_rng(seed), len(TAGS)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.3, (N_SYMBOLS, 4 * hidden))
            self.p[f"u{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
            self.p[f"o{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, t))
        self.p["bias"], self.p["move"] = np.zeros(t), np.zeros((t, t))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction for x (time, batch), in the order they are made."""
        p, h = self.p, self.h
        n, b = x.shape
        gates_in = p[f"x{d}"] + p[f"c{d}"]
        s, c = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        out, saved = np.empty((n, b, h), np.float32), []
        for t in range(n):
            z = gates_in[x[t]] + s @ p[f"u{d}"]
            g = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before = c
            c = g[:, h : 2 * h] * c + g[:, :h] * new
            tc = np.tanh(c)
            if keep:
                saved.append((s, before, g, new, tc))
            s = g[:, 2 * h :] * tc
            out[t] = s
        return out, saved

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tag)."""
        f, sf = self._direction(x, "f", keep)
        b, sb = self._direction(x[::-1], "b", keep)
        return f @ self.p["of"] + b[::-1] @ self.p["ob"] + self.p["bias"], (f, sf, b, sb)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y and its gradients."""
        p, (n, b), k = self.p, x.shape, len(TAGS)
        e, (f, sf, bw, sb) = self.scores(x, True)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)

        for t in range(1, n):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + p["move"], 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(p["move"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(b)
        gold = sum(e[t, rows, y[t]] for t in range(n)) + sum(p["move"][y[t - 1], y[t]] for t in range(1, n))
        de = np.exp(alpha + beta - z[:, None])
        dmove = np.zeros_like(p["move"])
        for t in range(1, n):
            dmove += np.exp(alpha[t - 1][:, :, None] + p["move"] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dmove, (y[t - 1], y[t]), -1)
        for t in range(n):
            de[t, rows, y[t]] -= 1
        g = {"move": dmove / b, "bias": de.sum((0, 1)) / b}
        for d, states, saved, dd, xs in (("f", f, sf, de, x), ("b", bw, sb, de[::-1], x[::-1])):
            g[f"o{d}"] = np.einsum("tbh,tbk->hk", states, dd) / b
            g |= self._back(d, dd @ p[f"o{d}"].T, saved, xs, b)
        return float((z - gold).mean()), g

    def _back(self, d, ds, saved, x, b):
        p, h = self.p, self.h
        du, dx = np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"x{d}"])
        sn, cn = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for t in range(len(saved) - 1, -1, -1):
            s, before, g, new, tc = saved[t]
            i, fo, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            sn = sn + ds[t]
            cn = cn + sn * o * (1 - tc * tc)
            z = np.concatenate([cn * new * i * (1 - i), cn * before * fo * (1 - fo), sn * tc * o * (1 - o), cn * i * (1 - new * new)], 1)
            du += s.T @ z
            np.add.at(dx, x[t], z)
            sn, cn = z @ p[f"u{d}"].T, cn * fo
        return {f"u{d}": du / b, f"x{d}": dx / b, f"c{d}": dx.sum(0) / b}

    def train(self, cases: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 420, batch: int = 64, rate: float = 0.02, seed: int = 3) -> CharTagger:
        """Adam over random batches of labelled texts; each text is one window."""
        xs = np.stack([_window(text) for text, _ in cases])
        ys = np.stack([_tags(spans) for _, spans in cases])
        r, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            rows = r.integers(0, len(xs), batch)
            _, g = self.loss(xs[rows].T, ys[rows].T)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                d = np.clip(d, -1, 1)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, batch) for windows x (batch, time), and each tag's margin over O."""
        e, _ = self.scores(np.ascontiguousarray(x.T))
        n, b, k = e.shape
        move, best, back = self.p["move"], e[0], np.empty((n, b, k), np.int8)
        for t in range(1, n):
            a = best[:, :, None] + move
            back[t] = a.argmax(1)
            best = e[t] + a.max(1)
        tags = np.empty((n, b), np.int64)
        tags[-1] = best.argmax(1)
        rows = np.arange(b)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]


def _window(text: str) -> np.ndarray:
    out = np.full(CASE, 1, np.int64)
    s = symbols(text[:CASE])
    out[: len(s)] = s
    return out


def _tags(spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(CASE, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    return y


def labelled_spans(n: int = 4000, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled windows to learn from: each kind in plain and in loose forms, and numbers that are none."""
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeiouabcdefghilmnoprstuvé") for _ in range(r.randint(2, 9)))

    def email():
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" [@] ", "."), ("(@)", ".")])
        return f"{word()}{pick(['.', '_', '', num(2)])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'example'])}"

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        sep = pick([" ", "-", "", ".", "/"])
        return sep.join(num(4) for _ in range(4))

    def phone():
        lead = pick(["+" + num(1) + " ", "+" + num(2) + "-", "", "", "00" + num(2) + " "])
        return lead + pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])

    def none():
        return pick([num(r.randint(1, 6)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}", f"[{num(2)}]", f"{num(2)}:{num(2)}", f"{num(2)} %", num(24), f"{word()}{num(3)}", word()])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, None: none}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 6))), []
        for kind in r.choices(list(makers), [2, 1.5, 2, 2.5, 3], k=r.randint(1, 3)):
            made = makers[kind]()
            text += pick([" ", " ", "\n", ", ", ": ", ". "])
            if kind and len(text) + len(made) < CASE:
                spans.append((kind, len(text), len(text) + len(made)))
            elif kind:
                break
            text += made
            text += pick([" ", ", ", ".", ".\n"]) + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text[:CASE], spans))
    return out


@lru_cache(maxsize=2)
def default_tagger() -> CharTagger:
    return CharTagger().train(labelled_spans())


def _window_spans(tags: list[int], margin: list[float]) -> list[tuple[int, int, int, float]]:
    out, t, n = [], 0, len(tags)
    while t < n:
        if tags[t] and tags[t] % 2:
            kind, a = tags[t], t
            t += 1
            while t < n and tags[t] == kind + 1:
                t += 1
            out.append((kind // 2, a, t, sum(margin[a:t])))
        else:
            t += 1
    return out


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, score) spans of all windows, the best-scoring set without overlaps."""
    spans = sorted({(k, a, b): s for k, a, b, s in sorted(spans, key=lambda x: x[3])}.items(), key=lambda x: (x[0][2], x[0]))
    ends = [k[2] for k, _ in spans]
    best: list[float] = [0.0]
    took: list[int | None] = []
    for i, ((_, a, _b), score) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        took.append(j if best[j] + score > best[i] else None)
        best.append(max(best[i], best[j] + score))
    out, i = [], len(spans)
    while i:
        j = took[i - 1]
        if j is None:
            i -= 1
        else:
            out.append(spans[i - 1][0])
            i = j
    return out[::-1]


MIN_DIGITS = {"email": 0, "ip": 4, "card": 13, "phone": 9}
MARK = re.compile(r"[0-9@]")
#: Windows that are decoded at once.
BATCH_WINDOWS = 512


def stitched(pieces: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """Spans longer than ``WHOLE``, of (kind, start, end, score, cut left, cut right) pieces of neighbouring windows."""
    out, runs = [], {}
    for kind, a, b, score, left, right in sorted(pieces, key=lambda p: (p[1], p[2])):
        run = runs.get(kind)
        if left and run and run[5] and a <= run[1]:
            # a piece's end holds unless its window cut it off
            runs[kind] = (run[0], max(b, run[1]), run[2] + score, run[3] + b - a, run[4], right if b >= run[1] else run[5])
        elif not run or not left:
            runs[kind] = run = (a, b, score, b - a, not left, right)
        else:
            runs.pop(kind)
            continue
        a, b, score, seen, begun, open_end = runs[kind]
        if begun and not open_end and b - a > WHOLE:
            out.append((kind, a, b, score * (b - a) / seen))
    return out


def model_spans(tagger: CharTagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the model finds in each text, reconciled over its windows."""
    found, pieces, coded = [[] for _ in texts], [[] for _ in texts], {}
    todo = []
    for i, text in enumerate(texts):
        last = -1
        for m in MARK.finditer(text):
            # the windows that hold this character: from (p - WINDOW, p], at multiples of STRIDE
            p = m.start()
            first = max(last + 1, (p - WINDOW) // STRIDE + 1, 0)
            todo += [(i, k) for k in range(first, p // STRIDE + 1)]
            last = max(last, p // STRIDE)
    done = set(todo)
    while todo:
        part, todo = todo[:BATCH_WINDOWS], todo[BATCH_WINDOWS:]
        x = np.full((len(part), WINDOW), 1, np.int64)
        for row, (i, k) in zip(x, part, strict=True):
            if i not in coded:
                coded[i] = symbols(texts[i])
            s = coded[i][k * STRIDE : k * STRIDE + WINDOW]
            row[: len(s)] = s
        tags, margin = tagger.decode(x)
        for w in np.flatnonzero(tags.any(0)).tolist():
            i, k = part[w]
            at, n = k * STRIDE, len(texts[i])
            for kind, a, b, score in _window_spans(tags[:, w].tolist(), margin[:, w].tolist()):
                left, right = a == 0 and at > 0, b == WINDOW and at + WINDOW < n
                if left or right:
                    pieces[i].append((kind, at + a, at + b, score, left, right))
                    for near in [(i, k - 1)] * left + [(i, k + 1)] * right:
                        if near not in done:
                            done.add(near)
                            todo.append(near)
                elif at + b <= n:
                    found[i].append((kind, at + a, at + b, score))
    for spans, cut in zip(found, pieces, strict=True):
        spans += stitched(cut)
    out = []
    for text, spans in zip(texts, found, strict=True):
        kept = []
        for kind, a, b in reconciled(spans):
            name = KINDS[kind]
            part = text[a:b]
            if (name == "email" and "@" in part) or (name != "email" and len(_digits(part)) >= MIN_DIGITS[name]):
                kept.append((name, a, b))
        out.append(kept)
    return out


def all_spans(tagger: CharTagger, texts: list[str]) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text the spans of the rules by kind, and all spans (kind, start, end)."""
    out = []
    for text, more in zip(texts, model_spans(tagger, texts), strict=True):
        base = rule_spans(text)
        spans = [(k, a, b) for k in KINDS for a, b in base[k]]
        held = sorted((a, b) for _, a, b in spans)
        # rule spans of different kinds may overlap, so ends are not sorted: running maxima are
        tops = np.maximum.accumulate([b for _, b in held]).tolist() if held else []
        starts = [a for a, _ in held]
        for k, a, b in more:
            j = bisect_right(starts, b - 1)
            if not j or tops[j - 1] <= a:
                spans.append((k, a, b))
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, spans))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, tagger: CharTagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by the rules, their digest, and all spans."""
    model = tagger or default_tagger()

    def make():
        def work(ids, texts):
            out = []
            for d, (base, spans) in zip(ids, all_spans(model, texts), strict=True):
                digest = hashlib.sha256(joined((k, a, b) for k in KINDS for a, b in base[k]).encode()).hexdigest()
                out.append((d, *(len(base[k]) for k in KINDS), digest, joined(spans)))
            return out

        return work

    return per_text(docs, id_col, text_col, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redacted(docs: DataFrame, tagger: CharTagger | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets."""
    model = tagger or default_tagger()

    def make():
        def work(texts):
            new = []
            for text, (_, spans) in zip(texts, all_spans(model, texts), strict=True):
                if not spans:
                    new.append(None)
                    continue
                out, at = [], 0
                for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b <= at:
                        continue
                    out += [text[at:a], f"[{k.upper()}]"] if a >= at else []
                    at = b
                new.append("".join([*out, text[at:]]))
            return [True] * len(texts), new

        return work

    return per_row(docs, text_col, make)
