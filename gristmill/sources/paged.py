"""A listing captured page by page, newest first, as a Spark data source that reads only the pages it needs.

``capture`` writes the pages and an index with each page's bounds. Reading
``format("paged_listing")`` takes bounds on the ordering column from pushed filters
(``spark.sql.python.filterPushdown.enabled``); the scan walks the index from the
newest page, passes over pages above the bounds and stops at the first one below
them. Each page that is left is a partition. Spark filters the rows again.

Files are opened through Arrow's file systems, so a page lies wherever these reach.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence

import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from gristmill.operators.places import numbered

NAME = "paged_listing"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def capture(rows: DataFrame, order: str, unique: str, path: str, size: int) -> None:
    """Write ``rows`` as pages of ``size``, newest by ``order`` (a date) first, ties by ``unique``; null dates are on no page."""
    dated = rows.where(F.col(order).isNotNull()).withColumn("all", F.lit(0))
    placed = numbered(dated, "all", [F.col(order).desc(), F.col(unique)]).withColumn("page", F.floor(F.col("place") / size).cast("long"))
    row = F.struct("place", F.struct(*rows.columns).alias("row"))
    pages = placed.groupBy("page").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])).alias("value"))
    pages.select("page", "value").write.partitionBy("page").text(f"{path}/pages")
    placed.groupBy("page").agg(F.min(order).alias("low"), F.max(order).alias("high")).write.parquet(f"{path}/index")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.order = schema, options["path"], options["order"]
        self.low: dt.date | None = None
        self.high: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.order,) and hasattr(f, "value"):
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)) and values:
                    self.low = max(filter(None, [self.low, min(values)]))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)) and values:
                    self.high = min(filter(None, [self.high, max(values)]))
            # bounds choose pages; rows are Spark's to filter
            yield f

    def partitions(self) -> Sequence[Page]:
        files, path = _located(f"{self.path}/index")
        index = ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=True).to_table().sort_by("page").to_pylist()
        chosen = []
        for page in index:
            if self.low is not None and page["high"] < self.low:
                break
            if self.high is None or page["low"] <= self.high:
                chosen.append(Page(page["page"]))
        return chosen

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no page was chosen
            return
        files, path = _located(f"{self.path}/pages/page={partition.number}")
        names = [f.name for f in self.schema.fields]
        dates = {f.name for f in self.schema.fields if f.dataType.typeName() == "date"}
        for info in files.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith(("_", ".")):
                continue
            with files.open_input_stream(info.path) as stream:
                for row in json.loads(stream.read()):
                    yield tuple(dt.date.fromisoformat(row[n]) if n in dates and row.get(n) else row.get(n) for n in names)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_pages(spark: SparkSession, path: str, columns: str, order: str, *bounds: Column) -> DataFrame:
    """The rows of a captured listing that meet ``bounds``; bounds on ``order`` choose the pages that are read."""
    spark.dataSource.register(PagedListing)
    spark.conf.set(PUSHDOWN, "true")
    rows = spark.read.format(NAME).option("path", path).option("columns", columns).option("order", order).load()
    for b in bounds:
        rows = rows.where(b)
    return rows
