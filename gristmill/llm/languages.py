"""Language identification by interpolated Kneser-Ney models of characters.

A language's model predicts a character from the ``ORDER - 1`` before it. A gram
is packed into 64 bits, 16 a character, and put through an invertible mixer: so
hashes never collide, and Spark derives shorter grams from longer ones with bit
operations. Counts cover every training document; the lower orders count what
comes before a gram (continuations), the discount of each order and language
comes from its counts of counts. A model is a few sorted arrays of hashes with
the discounted share of each gram and the weight of each context, see
:class:`Models`; a gram that no language has seen falls back to shorter ones.
Tasks hold at most ``MOST_CELLS`` / languages grams an order. Where an order has
more, the orders stay tables, tasks hold the finished logarithms of the most
frequent longest grams, and what else a text has is joined with the tables, see
:func:`text_bits`; so the limit changes where a gram is looked up, not what a
text gets.

A text is the sequence of its letters (with marks, in lower case, other
characters as one space). The language of the lowest cross-entropy a character
is chosen. One training document in ``SPARE`` is kept out of the counts: on
``MOST_SPARE`` of these at most, chosen by a hash of doc_id, the temperature of
the score is fitted and, for each language, the cross-entropy that its texts of
some length stay under; a text above that is rejected, as is one whose score is
low.

Null and blank texts, and those without a letter, get ``und`` and a score of 0.
Ties go to the language that sorts first. Rows with null or repeated doc_ids
are judged like any other but null ones teach nothing; null languages teach
nothing; without training rows all is ``und``. Columns other than the named ones
are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import held_out, mixed, slices, stored

ORDER = 4
#: Grams times languages that tasks hold of each order; others are joined.
MOST_CELLS = 4_000_000
SPARE = 16
MOST_SPARE = 2_000
#: Characters that are worked on at once.
PIECE = 1_000_000
#: Grams that a counting task holds before it sends them on.
HELD_GRAMS = 500_000
UNKNOWN = "und"
SPACE, START = 0, 1
BITS = 16
#: A text is rejected below this score, or beyond this many deviations from its language's texts.
LOW_SCORE, DEVIATIONS = 0.5, 5.0


@lru_cache(1)
def alphabet() -> np.ndarray:
    """The code of each code point: its lower case in 16 bits if it is a letter or a mark, else a space."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x41, 0x32400):
        char = chr(c)
        if unicodedata.category(char)[0] in "LM":
            low = ord(char.lower()[0])
            table[c] = low if low < 1 << BITS else 2 + low % 65_521
    return table


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    table = np.zeros(0x110000, bool)
    for c in range(0x41, 0x32400):
        table[c] = chr(c).isalpha()
    return table


def pieces(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) of about ``PIECE`` characters; a long text is cut."""
    now, size = [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            take = min(len(text) - start, PIECE - size)
            now.append((i, start, start + take))
            start, size = start + take, size + take
            if size >= PIECE:
                yield now
                now, size = [], 0
            if start >= len(text):
                break
    if now:
        yield now


class Grams:
    """Turns texts into grams, in order; remembers what a cut text ended with."""

    def __init__(self):
        self.tail: np.ndarray | None = None

    def of(self, texts: list[str], batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed grams, the place in ``batch`` each belongs to, and whether a piece holds a letter."""
        context = ORDER - 1
        points = np.frombuffer("".join(texts[i][a:b] for i, a, b in batch).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([b - a for _, a, b in batch])
        ends = np.cumsum(sizes)
        # each piece after ``context`` codes: the start of a text, or what the piece before ended with
        where = np.arange(len(points)) + np.repeat(np.arange(1, len(batch) + 1) * context, sizes)
        codes = np.full(len(points) + context * len(batch), START, np.uint16)
        codes[where] = alphabet()[points]
        if batch[0][1]:
            codes[:context] = self.tail
        owner = np.repeat(np.arange(len(batch)), sizes + context)
        given = np.ones(len(codes), bool)
        given[where] = False
        before = np.concatenate([[START], codes[:-1]])
        keep = given | (codes != SPACE) | ~((before == SPACE) | (before == START))
        codes, owner, given = codes[keep], owner[keep], given[keep]
        self.tail = codes[-context:].copy()
        wide = codes.astype(np.uint64)
        packed = wide[context:].copy()
        for k in range(1, ORDER):
            packed |= wide[context - k : len(wide) - k] << np.uint64(BITS * k)
        real = ~given[context:]
        known = np.zeros(len(batch), bool)
        if len(points):
            full = sizes > 0
            known[full] = np.logical_or.reduceat(letters()[points], (ends - sizes)[full])
        return packed[real], owner[context:][real], known


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows of ``docs`` (lang, text); a row for each task that met the gram."""

    def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.add.reduceat(counts, new)

    def sent(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, some in by_lang.items():
                grams = Grams()
                for piece in pieces(some):
                    keys = np.sort(grams.of(some, piece)[0])
                    if not len(keys):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    counts = np.diff(np.append(new, len(keys)))
                    old = held.get(lang)
                    held[lang] = merged(np.concatenate([old[0], keys[new]]), np.concatenate([old[1], counts])) if old else (keys[new], counts)
                    if sum(len(k) for k, _ in held.values()) > HELD_GRAMS:
                        for x, (k, c) in held.items():
                            yield sent(x, k, c)
                        held = {}
        for x, (k, c) in held.items():
            yield sent(x, k, c)

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long")


def _shares(grams: DataFrame) -> DataFrame:
    """(lang, gram, context, share, often) of one order, from its (lang, gram, n): what is left of each gram's share after the discount."""
    counted = grams.groupBy("lang").agg(
        F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.count(F.when(F.col("n") == 2, 1)).alias("twos"), F.sum("n").alias("all")
    )
    discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
    context = F.shiftrightunsigned("gram", BITS).alias("context")
    totals = grams.groupBy("lang", context).agg(F.sum("n").alias("c"))
    found = grams.select("lang", "gram", "n", context).join(counted.select("lang", discount.alias("d"), "all"), "lang").join(totals, ["lang", "context"])
    return found.select("lang", "gram", "context", ((F.col("n") - F.col("d")) / F.col("c")).alias("share"), (F.col("n") / F.col("all")).alias("often"))


@dataclass
class Order:
    """One order's grams and contexts: sorted hashes, and a column a language."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _found(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies in sorted ``hashes``, and whether it does."""
    if not len(hashes):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return at, hashes[at] == keys


@dataclass
class Models:
    """All languages' models; ``orders`` from one character up, or ``tables`` in their place where they are too many to hold."""

    langs: list[str]
    orders: list[Order]
    symbols: int
    #: hashes of the longest grams that any language has, and their log2 probabilities, a row a language
    known: np.ndarray | None = None
    logs: np.ndarray | None = None
    #: from one character up, (gram, shares) and (context, weights), an element a language
    tables: list[tuple[DataFrame, DataFrame]] | None = None

    def probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Probability of each gram's last character after the others, a row a gram, a column a language."""
        found = np.full((len(packed), len(self.langs)), 1.0 / self.symbols)
        for k, order in enumerate(self.orders, 1):
            own = packed & np.uint64((1 << BITS * k) - 1) if k < ORDER else packed
            at, here = _found(order.contexts, mixed(own >> np.uint64(BITS)))
            found *= np.where(here[:, None], order.weights[at] if len(order.weights) else 1.0, 1.0)
            at, here = _found(order.grams, mixed(own))
            if here.any():
                found[here] += order.shares[at[here]]
        return found

    def prepared(self, grams: np.ndarray) -> Models:
        """With the log probabilities of these grams worked out."""
        hashes = mixed(grams)
        order = np.argsort(hashes)
        self.known, self.logs = hashes[order], np.log2(self.probabilities(grams[order])).T.astype(np.float32).copy()
        return self

    def held_bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Bits of each text's known grams under each language, its characters, whether there is a letter, and (texts, grams, times) of the others."""
        bits, sizes, letters_in = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        grams, others = Grams(), []
        for batch in pieces(texts):
            packed, owner, letter = grams.of(texts, batch)
            rows = np.array([i for i, _, _ in batch])
            np.logical_or.at(letters_in, rows, letter)
            if not len(packed):
                continue
            at, here = _found(self.known, mixed(packed))
            np.add.at(sizes, rows, np.bincount(owner, minlength=len(batch)))
            for k in range(len(self.langs)):
                logs = np.where(here, self.logs[k][at], np.float32(0)) if len(self.known) else np.zeros(len(packed), np.float32)
                np.add.at(bits[:, k], rows, -np.bincount(owner, logs, len(batch)))
            of, other = owner[~here], packed[~here]
            order = np.lexsort((other, of))
            of, other = of[order], other[order]
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (other[1:] != other[:-1])])) if len(of) else np.zeros(0, np.int64)
            others.append((rows[of[new]], other[new], np.diff(np.append(new, len(of)))))
        return bits, sizes, letters_in, others

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text under each language, the number of characters, and whether there is a letter; for models without tables."""
        bits, sizes, known, others = self.held_bits(texts)
        for rows, grams, times in others:
            if len(grams):
                unique, back = np.unique(grams, return_inverse=True)
                np.add.at(bits, rows, -np.log2(self.probabilities(unique)).astype(np.float32)[back] * times[:, None].astype(float))
        return bits / np.maximum(sizes, 1)[:, None], sizes, known


@dataclass
class Identifier:
    """Models with what was calibrated: ``sharpness`` of the score, and (mean, between, within) of each language's cross-entropies."""

    models: Models
    sharpness: float
    usual: np.ndarray

    def judged(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; for models without tables."""
        return self.verdicts(*self.models.entropies(texts)) if self.models.langs else [(UNKNOWN, 0.0, True)] * len(texts)

    def verdicts(self, bits: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of texts, from what :meth:`Models.entropies` gives."""
        langs = self.models.langs
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        scores = 1 / np.exp(-np.minimum(self.sharpness * (bits - least[:, None]) * np.sqrt(np.maximum(sizes, 1))[:, None], 700)).sum(1)
        mean, between, within = self.usual[best].T
        far = least > mean + DEVIATIONS * np.sqrt(between + within / np.maximum(sizes, 1))
        return [(langs[b], float(s), bool(f or s < LOW_SCORE)) if k else (UNKNOWN, 0.0, True) for b, s, f, k in zip(best, scores, far, known, strict=True)]


def calibrated(models: Models, y: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> Identifier:
    """An identifier fitted on texts of known language (numbers ``y``, what :meth:`Models.entropies` gives); without any it rejects low scores only."""
    n = len(models.langs)
    usual = np.tile([np.inf, 0.0, 0.0], (n, 1))
    if not len(y):
        return Identifier(models, 1.0, usual)
    everyone = np.ones(len(y), bool)
    for k in range(n):
        # a language with few texts is measured by all languages' texts
        of = y == k if (y == k).sum() >= 8 else everyone
        own, m = bits[of, y[of]], sizes[of]
        mean = float(np.average(own, weights=m))
        spread = (own - mean) ** 2
        # spread = between + within / length, both at least 0
        within = max(0.0, float(np.polyfit(1 / m, spread, 1)[0])) if np.ptp(1 / m) > 0 else 0.0
        usual[k] = mean, max(1e-4, float(np.mean(np.maximum(spread - within / m, 0)))), within
    gaps = (bits - bits[np.arange(len(y)), y][:, None]) * np.sqrt(sizes)[:, None]
    tried = [2.0**k for k in range(-8, 5)]
    losses = [float(np.log(np.exp(np.clip(-s * gaps, -60, 60)).sum(1)).mean()) for s in tried]
    return Identifier(models, tried[int(np.argmin(losses))], usual)


def _packed(rows: list, langs: list[str], value: str, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the keys, their values by language, and the keys themselves in that order."""
    keys = np.array([r[key] for r in rows], np.int64).view(np.uint64)
    unique, at = np.unique(keys, return_inverse=True)
    values = np.full((len(unique), len(langs)), np.nan)
    number = {x: i for i, x in enumerate(langs)}
    values[at, [number[r["lang"]] for r in rows]] = [r[value] for r in rows]
    hashes = mixed(unique)
    order = np.argsort(hashes)
    return hashes[order], values[order], unique[order]


def _by_language(found: DataFrame, key: str, value: str, langs: list[str], without: float) -> DataFrame:
    """(key, value): the values of all languages as one list, ``without`` where a language has none."""
    values = F.map_from_entries(F.collect_list(F.struct("lang", value)))
    return found.groupBy(key).agg(values.alias("by")).select(key, F.transform(F.lit(langs), lambda x: F.coalesce(F.try_element_at("by", x), F.lit(without))).alias(value))


def gram_logs(grams: DataFrame, models: Models) -> DataFrame:
    """(gram, logs): log2 probabilities of the different ``grams``, an element a language, by ``models.tables``."""
    n = len(models.langs)
    out = grams.select("gram", F.array_repeat(F.lit(1.0 / models.symbols), n).alias("p"))
    for k, (shares, weights) in enumerate(models.tables, 1):
        own = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else F.col("gram")
        # what hangs on one character has 65,536 keys at most
        shares, weights = F.broadcast(shares) if k == 1 else shares, F.broadcast(weights) if k <= 2 else weights
        out = out.select("gram", "p", own.alias("own"), F.shiftrightunsigned(own, BITS).alias("context"))
        out = out.join(weights, "context", "left").join(shares.withColumnRenamed("gram", "own"), "own", "left")
        p = F.zip_with("p", F.coalesce("weights", F.array_repeat(F.lit(1.0), n)), lambda x, y: x * y)
        out = out.select("gram", F.zip_with(p, F.coalesce("shares", F.array_repeat(F.lit(0.0), n)), lambda x, y: x + y).alias("p"))
    return out.select("gram", F.transform("p", lambda x: F.log2(x).cast("float")).alias("logs"))


def fit_models(docs: DataFrame, most_cells: int = MOST_CELLS) -> Models:
    """Models of the languages in ``docs`` (lang, text), from all grams of all its rows."""
    grams = stored(gram_counts(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    most = most_cells // max(1, len(langs))
    found: list[DataFrame] = []
    fits = True
    for k in range(ORDER, 0, -1):
        fits = fits and grams.count() <= most
        found.insert(0, stored(_shares(grams), "language-shares"))
        if k > 1:
            # the next order counts the different characters before its grams
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("gram")
            grams = stored(grams.groupBy("lang", shorter).agg(F.count("*").alias("n")), "language-grams")
    weights = [x.groupBy("lang", "context").agg((1 - F.sum("share")).alias("weights")) for x in found]
    if not fits:
        shares = [_by_language(x.withColumnRenamed("share", "shares"), "gram", "shares", langs, 0.0) for x in found]
        tables = [(stored(x, "language-shares"), stored(_by_language(w, "context", "weights", langs, 1.0), "language-weights")) for x, w in zip(shares, weights, strict=True)]
        models = Models(langs, [], 2 + tables[0][0].count(), tables=tables)
        often = found[-1].groupBy("gram").agg(F.max("often").alias("often")).orderBy(F.desc("often"), "gram").limit(most)
        held = gram_logs(often, models).toArrow().combine_chunks()
        hashes = mixed(held["gram"].to_numpy().view(np.uint64))
        order = np.argsort(hashes)
        logs = np.array(held["logs"].combine_chunks().flatten(), np.float32).reshape(-1, len(langs))
        models.known, models.logs = hashes[order], logs[order].T.copy()
        return models
    orders: list[Order] = []
    for x, w in zip(found, weights, strict=True):
        hashes, shares_of, packed = _packed(x.select("lang", "gram", "share").collect(), langs, "share", "gram")
        contexts, weights_of, _ = _packed(w.collect(), langs, "weights", "context")
        orders.append(Order(hashes, np.nan_to_num(shares_of, nan=0.0), contexts, np.nan_to_num(weights_of, nan=1.0)))
    return Models(langs, orders, 2 + len(orders[0].grams)).prepared(packed)


def text_bits(docs: DataFrame, models: Models) -> DataFrame:
    """Columns of ``docs`` but its last, the text, with bits (a character, an element a language), n (characters) and letter (whether there is one).

    Without tables a text is measured where it lies. Else its known grams are, and
    the different other ones of all texts are looked up once by joins with the
    tables; the rows are written to the shared folder in between.
    """
    columns = docs.columns[:-1]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(replace(models, tables=None))

    def listed(bits: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1], bits.ravel())

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sizes, letter = shared.value.entropies([t or "" for t in batch.column(len(columns)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed(bits), pa.array(sizes), pa.array(letter)], names=[*columns, "bits", "n", "letter"])

    def begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(len(columns)).to_pylist()]
            for a, b in slices(texts):
                bits, sizes, letter, others = shared.value.held_bits(texts[a:b])
                rows, grams, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*others, strict=True)) if others else [np.zeros(0, np.int64)] * 3
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (grams.view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns[:-1], listed(bits), pa.array(sizes), pa.array(letter), pa.array(np.arange(row, row + b - a)), *lists], names=[*columns, "bits", "n", "letter", "row", "grams", "times"]
                )
                row += b - a

    if not models.tables:
        return docs.mapInArrow(measured, kinds + "bits array<double>, n long, letter boolean")
    part = stored(docs.mapInArrow(begun, kinds + "bits array<double>, n long, letter boolean, row long, grams array<long>, times array<long>"), "language-texts")
    left = part.select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "x.grams", "x.times").withColumnRenamed("grams", "gram")
    logs = gram_logs(left.select("gram").distinct(), models)
    added = left.join(logs, "gram").groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("logs")[i].cast("double")) for i in range(len(models.langs))]).alias("added"))
    whole = F.zip_with("bits", F.coalesce("added", F.array_repeat(F.lit(0.0), len(models.langs))), lambda x, y: (x - y) / F.greatest("n", F.lit(1)))
    return part.join(added, "row", "left").select(*columns, whole.alias("bits"), "n", "letter")


def fit_languages(docs: DataFrame, lang: str = "lang", spare: int = SPARE, most_spare: int = MOST_SPARE, most_cells: int = MOST_CELLS) -> Identifier:
    """An identifier from all rows of ``docs`` that are not held out and have an id and a language."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h")
    )
    aside = F.pmod("h", F.lit(spare)) == 0
    models = fit_models(known.where(~aside), most_cells)
    if not models.langs:
        return Identifier(models, 1.0, np.zeros((0, 3)))
    found = text_bits(known.where(aside).select("lang", "h", "text"), models).where("letter AND n > 0")
    rows = [r for r in found.orderBy(F.xxhash64("h"), "h", "lang", "n", "bits").limit(most_spare).collect() if r["lang"] in models.langs]
    y = np.array([models.langs.index(r["lang"]) for r in rows], np.int64)
    return calibrated(models, y, np.array([r["bits"] for r in rows]), np.array([r["n"] for r in rows]))


def language_ids(docs: DataFrame, identifier: Identifier | None = None, reject: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``; with ``reject`` rejected rows get ``und``."""
    identifier = identifier or fit_languages(docs)
    tables = identifier.models.tables
    shared = docs.sparkSession.sparkContext.broadcast(replace(identifier, models=replace(identifier.models, tables=None)))

    def told(ids: pa.Array, got: list[tuple[str, float, bool]]) -> pa.RecordBatch:
        names = [UNKNOWN if reject and r else x for x, _, r in got]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(names, pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([r for _, _, r in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield told(batch.column(0), shared.value.judged([t or "" for t in batch.column(1).to_pylist()]))

    def run_measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            yield told(batch.column(0), shared.value.verdicts(bits, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return text_bits(texts, identifier.models).mapInArrow(run_measured, schema) if tables else texts.mapInArrow(run, schema)
