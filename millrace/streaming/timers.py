"""Pending changes as a stream: reminders, dismissal, undo windows and tombstones by event-time timers.

A change of a key waits until the next one.  While it waits it is reminded of
every ``every``, dismissed with the ``most``-th reminder, and can be undone for
``undo``.  A tombstone deletes what waits.  All of it goes by the rows' own time:
what a timer would have said before a row's time is said before the row counts,
so that the result does not depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.dialect import Dialect, Registry, on_tables
from ..session import scratch

R = Registry()
DAY = 86_400_000_000
#: Microseconds throughout, so that both forms add whole numbers.
OUT = "k long, kind string, event_id long, n int, moment long"


def due(since: int, n: int, undone: int, every: int, most: int, undo: int, upto: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """What is said of a change of time ``since`` up to a time, in order: (kind, n, at); with the reminders and the undo said by then."""
    out = []
    if not undone and since + undo <= upto:
        out.append(("expired", 0, since + undo))
        undone = 1
    while n < most and since + (n + 1) * every <= upto:
        n += 1
        out.append(("dismissed" if n == most else "reminded", n, since + n * every))
    return sorted(out, key=lambda x: x[2]), n, undone


class Pending(StatefulProcessor):
    """State of a key: the waiting change (event_id, its time, reminders and undo said, the timer set), or none.

    The store is another process: a key's state is read once a call and written once, whatever the number of its rows.
    """

    def __init__(self, every: int, most: int, undo: int, tombstone: str):
        self.every, self.most, self.undo, self.tombstone = every, most, undo, tombstone

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "event_id long, since long, n int, undone int, timer long")

    def close(self) -> None:
        pass

    def _say(self, key: int, held: tuple | None, upto: int) -> tuple[list[Row], tuple | None]:
        """What is due of the change, and the change; none if it is dismissed and has no undo left to say."""
        if held is None:
            return [], None
        event_id, since, n, undone = held
        said, n, undone = due(since, n, undone, self.every, self.most, self.undo, upto)
        return [Row(k=key, kind=kind, event_id=event_id, n=k, moment=at) for kind, k, at in said], None if n >= self.most and undone else (event_id, since, n, undone)

    def _keep(self, before: tuple | None, held: tuple | None) -> None:
        """Put the change in the place of what the store has, with the timer of what is due of it first."""
        if held is None and before is None or before is not None and held == tuple(before[:4]):
            return
        timer = None
        if held is not None:
            _, since, n, undone = held
            ahead = ([] if undone else [since + self.undo]) + ([] if n >= self.most else [since + (n + 1) * self.every])
            timer = -(-min(ahead) // 1000)
        if before is not None and before[4] != timer:
            self.handle.deleteTimer(before[4])
        if timer is None:
            self.waiting.clear()
            return
        # set anew even if it is the same one: it may be the one that has just expired
        self.handle.registerTimer(timer)
        self.waiting.update((*held, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.waiting.get()
        held, out = None if before is None else tuple(before[:4]), []
        for at, event_id, summary in sorted(((r["moment"], r["event_id"], r["summary"]) for r in rows), key=lambda r: r[:2]):
            said, held = self._say(key[0], held, at)
            out += said
            if held is not None and (at, event_id) < (held[1], held[0]):
                continue  # behind what is known already
            if summary == self.tombstone:
                out.append(Row(k=key[0], kind="deleted" if held is not None and held[2] < self.most else "absent", event_id=event_id, n=0, moment=at))
                held = None
            else:
                held = (event_id, at, 0, 0)
        self._keep(before, held)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # up to the watermark, as a timer that is set here and already due waits for the next batch
        before = self.waiting.get()
        said, held = self._say(key[0], None if before is None else tuple(before[:4]), 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._keep(before, held)
        yield from said


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers need this store; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_pending(stream: DataFrame, every: int = DAY, most: int = 3, undo: int = DAY // 2, tombstone: str = "error", late: str = "0 seconds") -> DataFrame:
    """(k, kind, event_id, n, moment) of a stream of changes (k, event_id, ts, summary).

    Kinds: reminded and dismissed (n the reminder), expired (undo is over), deleted,
    and absent (a tombstone of a key of which nothing waits).  Rows behind the
    watermark of the batch before are dropped, and so are rows older than the change
    that waits.
    """
    rows = stream.withWatermark("ts", late).select("k", "event_id", "ts", "summary", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))
    return rows.groupBy("k").transformWithState(statefulProcessor=Pending(every, most, undo, tombstone), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def append_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run an appending stream over what is there into files below ``path``."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def pending_sql(d: Dialect, rel: str, every: int = DAY, most: int = 3, undo: int = DAY // 2, tombstone: str = "error") -> str:
    """The batch form over (k, event_id, moment, summary): each change against the next one and the latest time of all."""
    over = "OVER (PARTITION BY k ORDER BY moment, event_id)"
    gone = d.lit(tombstone)
    x = f"SELECT k, event_id, moment, summary, lead(moment) {over} AS upcoming, lag(moment) {over} AS before, lag(summary) {over} AS was, m.latest FROM {rel} t CROSS JOIN (SELECT max(moment) AS latest FROM {rel} z) m"
    w = f"SELECT k, event_id, moment, summary, before, was, least(coalesce(upcoming, latest), latest) AS upto FROM ({x}) x"
    reminded = f"SELECT k, CASE WHEN n = {most} THEN 'dismissed' ELSE 'reminded' END AS kind, event_id, CAST(n AS INT) AS n, moment + n * {every} AS moment FROM ({w}) w CROSS JOIN (SELECT {d.unnest(d.seq('1', str(most)))} AS n) s WHERE summary <> {gone} AND moment + n * {every} <= upto"
    expired = f"SELECT k, 'expired', event_id, 0, moment + {undo} FROM ({w}) w WHERE summary <> {gone} AND moment + {undo} <= upto"
    deleted = f"SELECT k, CASE WHEN was <> {gone} AND before + {most} * CAST({every} AS BIGINT) > moment THEN 'deleted' ELSE 'absent' END, event_id, 0, moment FROM ({w}) w WHERE summary = {gone}"
    return f"{reminded} UNION ALL {expired} UNION ALL {deleted}"


def changes(d: Dialect) -> str:
    moment = "unix_micros(CAST(ts AS TIMESTAMP))" if d.spark else "epoch_us(ts)"
    return f"SELECT user_id AS k, event_id, {moment} AS moment, event_type AS summary FROM events"


R.op("state_pending", changes)(lambda d, rel: pending_sql(d, rel))


def _in_order(spark: SparkSession, sf_dir: str, files: int = 5) -> DataFrame:
    """The changes as a stream of one file a batch, one after the other in order of time."""
    src = scratch(spark, "pending-in")
    df = on_tables(spark, sf_dir, "SELECT user_id AS k, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS summary FROM events")
    at = F.unix_micros("ts")
    cuts = df.select(F.percentile_approx(at, [i / files for i in range(1, files)]).alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in cuts:
        part = part + (at > c).cast("int")
    for i in range(files):
        df.where(part == i).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


@R.query("stream_pending", R.sql["state_pending"], stream_pending)
def stream_pending_query(spark, sf_dir):
    """All events in several batches, in order of time."""
    with rocksdb(spark):
        stream = stream_pending(_in_order(spark, sf_dir))
        return append_to_end(stream, scratch(spark, "stream-pending"))


