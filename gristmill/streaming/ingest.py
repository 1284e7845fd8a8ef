"""Incremental ingest. Each job can be run again: what it has seen isn't counted twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def low_watermark(runs: DataFrame, started: str, ok: str, overlap: str) -> DataFrame:
    """From when to read: the start of the last run that succeeded, less an overlap; null if none did."""
    return runs.agg(F.max(F.when(F.col(ok), F.col(started))).alias("last")).select((F.col("last") - F.expr(f"INTERVAL {overlap}")).alias("since"))


def deduplicated(stream: DataFrame, keys: Sequence[str], moment: str, lateness: str) -> DataFrame:
    """The first row of each key, for rows at most ``lateness`` late."""
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(list(keys))


def weekly(stream: DataFrame, moment: str, lateness: str, *keys: str) -> DataFrame:
    """Counts by week from Monday; a week is given out once, when no more rows for it are awaited."""
    # epoch time starts on a Thursday
    week = F.window(moment, "7 days", startTime="4 days")
    return stream.withWatermark(moment, lateness).groupBy(week, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), *keys, "n")


def read_inbox(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """A folder of JSON files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has arrived and stop; the checkpoint remembers how far."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def changed_states(stream: DataFrame, key: str, state: str) -> DataFrame:
    """Rows whose state differs from the key's state before; the first sight of a key is silent."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, held):
        before = held.get[0] if held.exists else None
        seen = held.exists
        rows = []
        frame = pd.concat(list(frames)).sort_values(["seq"])
        for seq, now in zip(frame["seq"], frame[state], strict=True):
            if seen and now != before:
                rows.append((k[0], int(seq), before, now))
            before, seen = now, True
        held.update((before,))
        yield pd.DataFrame(rows, columns=[key, "seq", "before", "now"])

    schema = f"{key} long, seq long, before string, now string"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)
