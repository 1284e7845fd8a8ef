"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the first letters of
longer words, hashed to ``BUCKETS`` numbers. The machine adds a weight a term
and, for each pair of terms, the product of two short vectors; so it learns that
an insult beside a mention of a group means more than either alone, which no sum
of weights can say. Weights are fitted by AdaGrad with soft thresholds, which
keep terms that tell nothing at zero.

The fit reads a bounded sample of labelled rows, at most ``MOST_TRAIN`` of each
label, chosen by a hash of doc_id among rows that are not held out, one text an
id; scoring reads every row. Where that cap thins the labels unequally, the bias
is shifted by the log of the rates, so that scores hold for the mix of all
labelled rows at any size. Labels serve the fit alone.

Null texts are empty and get the score of no terms. Rows with null or repeated
doc_ids are scored like any other; of repeated labels a document has the larger.
Null labels are left out. With no labelled rows of both kinds every score is
the share of the label there is (0 without labels). Other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import held_out, per_row, per_text

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
PREFIX = 4
MOST_TRAIN = 5_000
MOST_WORDS = 400_000


class _Terms(dict):
    """word -> bucket of the word, and of its first letters in the upper half (0 if it is short)."""

    def __missing__(self, word: str) -> int:
        own = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        pre = 1 + crc32(("^" + word[:PREFIX]).encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if len(word) > PREFIX else 0
        value = own | pre << 32
        if len(self) < MOST_WORDS:
            self[word] = value
        return value


def terms(text: str, table: dict[str, int]) -> np.ndarray:
    """The distinct buckets of a text's terms, ascending."""
    found = set(WORD.findall(text.lower()))
    both = np.fromiter(map(table.__getitem__, found), np.int64, len(found))
    pre = both >> 32
    return np.unique(np.concatenate([both & 0xFFFFFFFF, pre[pre > 0]]))


@dataclass
class FactorizationMachine:
    """Score = sigmoid(bias + sum of weights + sum over pairs of products of factors)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(rows)[0], -30, 30)))

    def _sums(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        raw = np.full(len(rows), self.bias) + np.bincount(owner, self.weights[flat], len(rows))
        active = np.flatnonzero(self.factors[flat].any(1)) if len(flat) else np.zeros(0, np.int64)
        sums = np.zeros((len(rows), self.factors.shape[1]))
        for k in range(self.factors.shape[1]):
            v = self.factors[flat[active], k]
            sums[:, k] = np.bincount(owner[active], v, len(rows))
            raw += 0.5 * (sums[:, k] ** 2 - np.bincount(owner[active], v * v, len(rows)))
        return raw, sums, flat, owner

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, rank: int = 4, epochs: int = 15, batch: int = 64, rate: float = 0.1, l1: float = 3e-3, seed: int = 5) -> FactorizationMachine:
        r = np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            return cls(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(BUCKETS), np.zeros((BUCKETS, rank)))
        # terms of fewer than three rows tell nothing that carries over
        seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
        rows = [x[seen[x] >= 3] for x in rows]
        m = cls(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(BUCKETS), np.where(seen[:, None] >= 3, r.normal(0, 0.01, (BUCKETS, rank)), 0.0))
        gw, gv = np.full(BUCKETS, 1e-2), np.full((BUCKETS, rank), 1e-2)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for s in range(0, len(rows), batch):
                part = order[s : s + batch]
                raw, sums, flat, owner = m._sums([rows[i] for i in part])
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                m.bias -= rate * err.sum()
                ids, inverse = np.unique(flat, return_inverse=True)
                e = err[owner]
                d = np.bincount(inverse, e, len(ids))
                gw[ids] += d * d
                step = rate / np.sqrt(gw[ids])
                w = m.weights[ids] - step * d
                m.weights[ids] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
                for k in range(rank):
                    v = m.factors[ids, k]
                    d = np.bincount(inverse, e * (sums[owner, k] - m.factors[flat, k]), len(ids))
                    gv[ids, k] += d * d
                    step = rate / np.sqrt(gv[ids, k])
                    v = v - step * d
                    m.factors[ids, k] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAIN) -> FactorizationMachine:
    """A machine from the labelled rows that are not held out, at most ``most`` of each label."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # two limits bound the rows, so this side of the join is small at any size
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def make():
        table = _Terms()
        return lambda ids, texts: [(d, y, terms(t, table).astype("<i4").tobytes()) for (d, y), t in zip(ids, texts, strict=True)]

    found = per_text(held, [F.col("doc_id"), F.col("y").cast("long")], "text", "doc_id long, y long, terms binary", make)
    # an id may be repeated without bound in the documents: one text of it, the least by its terms, is sent
    one = found.groupBy("doc_id", "y").agg(F.min("terms").alias("terms")).select("y", "terms")
    rows = sorted((r[0], bytes(r[1])) for r in one.collect())
    model = FactorizationMachine.fit([np.frombuffer(t, "<i4").astype(np.int64) for _, t in rows], np.array([y for y, _ in rows], float))
    if counts.get(0) and counts.get(1):
        rate = {y: min(counts[y], most) / counts[y] for y in (0, 1)}
        model.bias -= float(np.log(rate[1] / rate[0]))
    return model


def _scorer(model: FactorizationMachine):
    """A picklable compact model: only terms with any weight travel."""
    used = np.flatnonzero((model.weights != 0) | model.factors.any(1))
    return model.bias, used, model.weights[used].astype(np.float32), model.factors[used].astype(np.float32)


def _loaded(compact) -> FactorizationMachine:
    bias, used, weights, factors = compact
    m = FactorizationMachine(bias, np.zeros(BUCKETS), np.zeros((BUCKETS, factors.shape[1])))
    m.weights[used], m.factors[used] = weights, factors
    return m


def _score_texts(model: FactorizationMachine, table: dict[str, int], texts: list[str]) -> list[float]:
    return model.scores([terms(t, table) for t in texts]).tolist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(_scorer(fit_toxicity(docs, labels)))

    def make():
        model, table = _loaded(shared.value), _Terms()
        return lambda ids, texts: list(zip(ids, _score_texts(model, table, texts), strict=True))

    scored = per_text(docs, "doc_id", "text", "doc_id long, score double", make)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(_scorer(fit_toxicity(docs, labels)))

    def make():
        model, table = _loaded(shared.value), _Terms()
        return lambda texts: ([s < threshold for s in _score_texts(model, table, texts)], None)

    return per_row(docs, "text", make)
