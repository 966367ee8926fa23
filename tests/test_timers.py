"""Pending changes as a stream against a plain walk and the batch form."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.plans.dialect import SPARK
from millrace.streaming import timers

SF = "/root/testdata/sf0.001"
H = 3_600_000_000


def walk(rows, every, most, undo, latest):
    """Each key's changes in turn, minute by minute of what is due."""
    out, keys = [], {}
    for k, event_id, moment, summary in rows:
        keys.setdefault(k, []).append((moment, event_id, summary))
    for k, changes in keys.items():
        changes.sort()
        alive = None
        for i, (moment, event_id, summary) in enumerate(changes):
            upto = min(changes[i + 1][0] if i + 1 < len(changes) else latest, latest)
            if summary == "error":
                out.append((k, "deleted" if alive is not None and alive + most * every > moment else "absent", event_id, 0, moment))
                alive = None
                continue
            alive = moment
            out += [(k, "dismissed" if n == most else "reminded", event_id, n, moment + n * every) for n in range(1, most + 1) if moment + n * every <= upto]
            out += [(k, "expired", event_id, 0, moment + undo)] if moment + undo <= upto else []
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("k", "kind", "event_id", "n", "moment")) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 6])
def test_timers_equal_a_walk_whatever_the_batches(spark, tmp_path, batches):
    rng = random.Random(3)
    t0, rows = 1_700_000_000_000_000, []
    for i in range(160):
        t0 += rng.choice([1, 10, 60, 600]) * 60_000_000 + rng.randrange(1000)
        rows.append((rng.randrange(9), i, t0, rng.choice(["view", "click", "error"])))
    df = spark.createDataFrame(rows, "k long, event_id long, moment long, summary string").withColumn("ts", F.timestamp_micros("moment"))
    src = str(tmp_path / "in")
    for b in range(batches):
        df.where((F.col("event_id") * batches / 160).cast("int") == b).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    with timers.rocksdb(spark):
        got = told(timers.append_to_end(timers.stream_pending(stream, 5 * H, 3, 2 * H), str(tmp_path / "out")))
    want = walk(rows, 5 * H, 3, 2 * H, t0)
    assert {w[1] for w in want} == {"reminded", "dismissed", "expired", "deleted", "absent"}
    assert got == want
    df.createOrReplaceTempView("pending_rows")
    assert told(spark.sql(timers.pending_sql(SPARK, "pending_rows", 5 * H, 3, 2 * H))) == want


def test_late_rows_change_nothing_that_was_said(spark, tmp_path):
    """A row behind the watermark of the batch before is dropped."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    src = str(tmp_path / "in")
    for part in ([(1, 1, at(0), "a")], [(2, 2, at(30), "a")], [(2, 5, at(31), "a")], [(1, 3, at(1), "error")], [(1, 4, at(40), "error")]):
        spark.createDataFrame(part, "k long, event_id long, ts timestamp, summary string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k long, event_id long, ts timestamp, summary string").option("maxFilesPerTrigger", 1).parquet(src)
    with timers.rocksdb(spark):
        got = told(timers.append_to_end(timers.stream_pending(stream, 24 * H, 3, 12 * H), str(tmp_path / "out")))
    assert [(k, kind, i, n) for k, kind, i, n, _ in got] == [(1, "deleted", 4, 0), (1, "expired", 1, 0), (1, "reminded", 1, 1)]


def test_stream_of_events_equals_the_batch_form(spark):
    assert told(registry.QUERIES["stream_pending"](spark, SF)) == told(registry.QUERIES["state_pending"](spark, SF))


class Store:
    """A handle and a value state that count how often they are called."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.discard(at)


def test_the_store_is_called_once_a_key_and_not_for_each_row():
    """A call goes to another process; there is one timer at most, that of the change that waits."""
    store, p = Store(), timers.Pending(5 * H, 3, 2 * H, "error")
    p.init(store)
    change = lambda i, summary="view": {"event_id": i, "moment": i * 3 * H, "summary": summary}
    for first in (1, 51):
        store.calls.clear()
        assert len(list(p.handleInputRows((7,), iter([change(i) for i in range(first, first + 50)]), None))) >= 49
        assert max(store.calls.count(c) for c in store.calls) == 1 and len(store.calls) <= 4
        assert store.value[0] == first + 49 and store.timers == {store.value[4]}
    list(p.handleInputRows((7,), iter([change(101, "error")]), None))
    assert store.value is None and not store.timers
