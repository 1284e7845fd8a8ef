"""Identity chains: everything that links lead to, in both directions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not where and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='gristmill-')}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, see :func:`kept`."""
    _ready(spark.range(0))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: its lineage ends there."""
    _ready(df)
    return df.checkpoint()


def chain_roots(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node that each one reaches.

    Nodes hand their smallest known root to their neighbours and then jump to
    their root's root, so long chains take few rounds. Each round is a
    checkpoint in the shared folder.
    """
    _ready(edges)
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    both = both.union(both.select("other", "node")).distinct().checkpoint()
    roots = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")).checkpoint()
    while True:
        heard = both.join(roots.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        step = roots.join(heard, "node").select("node", "root", F.least("root", "heard").alias("now"))
        jump = roots.select(F.col("node").alias("now"), F.col("root").alias("further"))
        new = step.join(jump, "now").select("node", "root", F.least("now", "further").alias("now")).checkpoint()
        changed = new.where("now <> root").isEmpty()
        roots = new.select("node", F.col("now").alias("root"))
        if changed:
            return roots
