"""Token counts of whole texts, without the ids.

Texts are encoded in Arrow batches and only lengths return. A task deals its
rows into batches of about equal bytes, and long texts are cut at safe
boundaries (see :mod:`gristmill.llm.encoding`), so neither many short texts nor
one very long text sets a task's memory.

Null texts count as empty: no bytes, no tokens. Null or repeated ids, ties and
other columns change nothing, since each row is counted alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import per_text
from gristmill.llm.encoding import Encoder

#: A batch for the library holds about this many UTF-8 bytes.
BATCH_BYTES = 1_000_000


def byte_batches(sizes: list[int], most: int = BATCH_BYTES) -> list[list[int]]:
    """Row numbers in batches of about ``most`` bytes, largest rows first into the lightest batch."""
    n = max(1, -(-sum(sizes) // most))
    if n == 1:
        return [list(range(len(sizes)))]
    import heapq

    heap, out = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (load + sizes[i], k))
    return [x for x in out if x]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""

    def make():
        encoder = Encoder.of(tokenizer)

        def work(ids, texts):
            sizes = [len(t.encode()) for t in texts]
            counts = [0] * len(texts)
            for rows in byte_batches(sizes):
                for i, n in zip(rows, encoder.counts([texts[i] for i in rows]), strict=True):
                    counts[i] = n
            return [(d, b, n) for d, b, n in zip(ids, sizes, counts, strict=True)]

        return work

    counted = per_text(docs, id_col, text_col, "doc_id long, n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
