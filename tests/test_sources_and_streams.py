"""Pages that are read and those that aren't, replays in any batching, batches that are killed and run again."""

import datetime as dt
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.sources import paged
from gristmill.streaming import changes, outbox

COLUMNS = "id long, name string, day date"


@pytest.fixture
def listing(spark, tmp_path):
    rows = [(i, f"n{i}" if i % 7 else None, dt.date(2024, 1, 1) + dt.timedelta(days=i // 3)) for i in range(100)] + [(500, "undated", None)]
    paged.capture(spark.createDataFrame(rows, COLUMNS), "day", "id", f"file://{tmp_path}/l", 10)
    return rows, tmp_path / "l"


def test_only_pages_within_bounds_are_read(spark, listing):
    rows, where = listing
    low, high = dt.date(2024, 1, 10), dt.date(2024, 1, 13)
    want = sorted(r for r in rows if r[2] and low <= r[2] <= high)
    # the pages that the bounds rule out are gone: reading one would fail
    index = {r.page: (r.low, r.high) for r in spark.read.parquet(f"file://{where}/index").collect()}
    needed = {p for p, (a, b) in index.items() if b >= low and a <= high}
    for p in set(index) - needed:
        shutil.rmtree(where / "pages" / f"page={p}")
    read = lambda *b: paged.read_pages(spark, f"file://{where}", COLUMNS, "day", *b)
    between = (F.col("day") >= F.lit(low), F.col("day") <= F.lit(high))
    assert sorted(map(tuple, read(*between).collect())) == want and len(index) == 10
    assert read(*between).rdd.getNumPartitions() == len(needed) < 5
    assert read(F.col("day") > F.lit(dt.date(2025, 1, 1))).count() == 0
    assert {r.id for r in read(F.col("day") == F.lit(low)).collect()} == {r[0] for r in rows if r[2] == low}


def test_all_pages_without_bounds(spark, listing):
    rows, where = listing
    got = paged.read_pages(spark, str(where), COLUMNS, "day", F.col("name").isNotNull())
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[2] and r[1]) and got.rdd.getNumPartitions() == 10


def test_changes_are_the_same_in_any_batching(spark, tmp_path):
    r = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(r.choice("abc"), start + dt.timedelta(hours=h // 2, minutes=r.choice([0, 0, 10])), r.choice(["new", "open", "done", None])) for h in range(120)]
    rows += [("a", start + dt.timedelta(days=12), "late"), ("a", start + dt.timedelta(days=12, hours=1), "new")]
    schema = "key string, at timestamp, state string"
    want = Counter(map(tuple, changes.changes_of(spark.createDataFrame(rows, schema), "key", "at", "state", 6 * 3600).collect()))
    assert want and not any(x[3] == "late" for x in want)
    spark.conf.set(*changes.PROVIDER)
    try:
        for n, order in ((1, "sorted"), (4, "late")):
            given = sorted(rows, key=lambda x: x[1])
            if order == "late":
                # rows come up to two days late, but never later than is allowed
                given.sort(key=lambda x: x[1] + dt.timedelta(hours=r.randint(0, 20)))
            source, out, check = (str(tmp_path / f"{n}-{x}") for x in ("in", "out", "check"))
            for part in range(n):
                batch = given[part * len(given) // n : (part + 1) * len(given) // n]
                spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
                run(spark, source, schema, out, check)
            spark.createDataFrame([("z", start + dt.timedelta(days=90), "end")], schema).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, schema, out, check)
            assert Counter(map(tuple, spark.read.parquet(out).select("key", "at", "before", "now").collect())) == want, order
    finally:
        spark.conf.unset(changes.PROVIDER[0])


def run(spark, source, schema, out, check):
    stream = changes.changes(spark.readStream.schema(schema).parquet(source), "key", "at", "state", "2 days", 6 * 3600)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_killed_batch_gives_each_message_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, body string"

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def deliver(after=None):
        outbox.deliver(spark.readStream.schema(schema).parquet(source), ["id", "body"], out, check, after)

    def killed(number):
        raise RuntimeError("killed between write and commit")

    sent = lambda: Counter((r.id, r.body) for r in outbox.sent(spark, out, f"{schema}, message_key string").collect())
    assert sent() == {}
    put((1, "a"), (1, "a"), (2, None))
    with pytest.raises(Exception, match="killed"):
        deliver(killed)
    assert sent() == {(1, "a"): 1, (2, None): 1}
    deliver()
    put((1, "a"), (2, "b"), (3, "c"))
    with pytest.raises(Exception, match="killed"):
        deliver(killed)
    deliver()
    deliver()
    assert sent() == {(1, "a"): 1, (2, None): 1, (2, "b"): 1, (3, "c"): 1}
    # the same batch once more, by hand
    outbox.put(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), 1, ["id", "body"], out)
    assert sent() == {(1, "a"): 1, (2, None): 1, (2, "b"): 1, (3, "c"): 1}


def test_a_batch_of_a_key_has_one_timer_and_few_calls():
    class Held:
        def __init__(self):
            self.items = []

        def get(self):
            calls.append("get")
            return iter(self.items) if self.many else self.items[0]

        def exists(self):
            calls.append("exists")
            return bool(self.items)

        def appendValue(self, x):
            calls.append("append")
            self.items.append(x)

        def update(self, x):
            calls.append("update")
            self.items = [x]

        def clear(self):
            calls.append("clear")
            self.items = []

    class Handle:
        def state(self, many):
            held = Held()
            held.many = many
            return held

        def getValueState(self, *_):
            return self.state(False)

        def getListState(self, *_):
            return self.state(True)

        def registerTimer(self, at):
            timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    calls, timers = [], []
    job = changes._Changes(10)
    job.init(Handle())
    rows = [(None, None, 1000 * i, "ab"[i // 3 % 2]) for i in range(1, 25_000)]
    assert list(job.handleInputRows(("k",), iter(rows + rows), Now(0))) == [] and timers == [1000] and len(calls) == 3
    told = [r.millis for r in job.handleExpiredTimer(("k",), Now(9_500), None)]
    # what still waits has a timer again
    assert told == [3000, 6000, 9000] and 10_000 in timers and len(timers) == 3
    told = [r.millis for r in job.handleExpiredTimer(("k",), Now(10**9), None)]
    assert told == [1000 * i for i in range(12, 25_000, 3)] and len(calls) < 20
