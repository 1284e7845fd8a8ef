"""An outbox that gives each message once, whatever is killed and run again.

A batch is written under its number before the stream remembers it as done. If a
batch is run again, because what ran it died between the two, it replaces what it
wrote; messages that an earlier batch holds are left out. Messages are told apart by
a digest of their content.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions.wording import content_key


def put(batch: DataFrame, number: int, content: Sequence[str], path: str) -> None:
    """Write the messages of a batch that no earlier batch holds; doing it again changes nothing."""
    spark = batch.sparkSession
    keyed = batch.withColumn("message_key", content_key(*[F.col(c) for c in content])).dropDuplicates(["message_key"])
    # only earlier batches count, not what a first try of this one has left
    earlier = sent(spark, path, "message_key string").where(F.col("batch") < number).select("message_key")
    keyed.join(earlier, "message_key", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")


def sent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All messages with the batch that gave them; none if there is no outbox yet."""
    files, none = spark._jvm.org.apache.hadoop.fs.Path(path), spark.createDataFrame([], f"{schema}, batch long")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return none
    return spark.read.schema(none.schema).option("basePath", path).parquet(path)


def deliver(stream: DataFrame, content: Sequence[str], path: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Work off what has arrived into the outbox at ``path``; ``after`` is called with the number of each batch that is written."""

    def one(batch: DataFrame, number: int) -> None:
        put(batch, number, content, path)
        if after:
            after(number)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
