"""Keyed state, in batch and as streams, and event-time windows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Registry, on_tables
from ..session import scratch

R = Registry()
op = R.op
CHANGES = "SELECT user_id AS k, event_id, ts, event_type AS summary, value FROM events"


def latest(rel):
    """The last change of each key with the time of its first; a sign of error deletes it."""
    return f"SELECT k, min(ts) AS created_at, max(ts) AS updated_at, max_by(summary, event_id) AS summary, max_by(value, event_id) AS value, max(event_id) AS event_id FROM {rel} t GROUP BY k"


@op("state_upsert", lambda d: CHANGES)
def state_upsert(d, rel):
    return f"SELECT k, {d.stamp('created_at')} AS created_at, {d.stamp('updated_at')} AS updated_at, summary, value FROM ({latest(rel)}) s"


@op("state_lookup", lambda d: CHANGES, key=17, text="PURCH")
def state_lookup(d, rel, key, text):
    """By key, or by a part of the summary in any case."""
    return f"SELECT k, summary, value FROM ({latest(rel)}) s WHERE k = {key} OR contains(lower(summary), {d.lit(text.lower())})"


@op("state_delete", lambda d: CHANGES)
def state_delete(d, rel):
    """State without keys whose last change is a tombstone."""
    return f"SELECT k, summary, value FROM ({latest(rel)}) s WHERE summary <> 'error'"


@op("state_pending_reminder", lambda d: CHANGES, today="2024-01-20", most=3)
def state_pending_reminder(d, rel, today, most):
    """Keys due from a day on, dismissed after the given number of reminders."""
    return f"SELECT k, due, reminders, CASE WHEN reminders >= {most} THEN 'dismissed' WHEN due >= {d.lit(today)} THEN 'due' ELSE 'past' END AS status FROM (SELECT k, {d.day('max(ts)')} AS due, CAST(sum(CASE WHEN summary = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS reminders FROM {rel} t GROUP BY k) x"


@op("state_undo_window", lambda d: CHANGES, now="2024-01-20 12:00:00")
def state_undo_window(d, rel, now):
    """The latest change of each key within 24 hours before ``now``."""
    return f"SELECT k, max_by(event_id, event_id) AS event_id, max_by(summary, event_id) AS summary FROM {rel} t WHERE ts <= TIMESTAMP '{now}' AND ts >= TIMESTAMP '{now}' - INTERVAL '24' HOUR GROUP BY k"


@op("win_tumbling_counts", "events")
def win_tumbling_counts(d, rel):
    """Events per day and type; ``stream_daily`` is the streaming form."""
    return f"SELECT {d.day('ts')} AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {rel} t GROUP BY 1, 2"


def stream_daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per day and type of a stream, with late rows dropped past the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream_state(stream: DataFrame) -> DataFrame:
    """Upserts of a stream: created_at of the first change and values of the last, per key; a streaming aggregate, so that no key costs a call of Python."""
    return stream.groupBy("k").agg(F.min("ts").alias("created_at"), F.max("event_id").alias("event_id"), F.max_by("summary", "event_id").alias("summary"))


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run an updating stream over what is there; each batch's rows go to files below ``path`` with the batch's number."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, _batch long").parquet(f"{path}/rows")


def last_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that updated it."""
    rest = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")


def _event_stream(spark, sf_dir: str, sql: str, files: int = 4) -> DataFrame:
    """A query over the events as files in order of time, one a batch."""
    src = scratch(spark, "stream-in")
    df = on_tables(spark, sf_dir, sql)
    df.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


@R.query("stream_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", stream_daily)
def stream_daily_query(spark, sf_dir):
    """All events in several batches; the watermark is as long as the data, so that no order of files drops rows."""
    stream = stream_daily(_event_stream(spark, sf_dir, "SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events"), "3650 days")
    rows = run_to_end(stream.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), scratch(spark, "stream-daily"))
    return last_update(rows, ["day", "event_type"]).withColumn("total", F.round("total", 4))


@R.query("stream_state", "SELECT user_id AS k, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, max(event_id) AS event_id, max_by(event_type, event_id) AS summary FROM events GROUP BY user_id", stream_state)
def stream_state_query(spark, sf_dir):
    """Upserts of all events in several batches."""
    stream = stream_state(_event_stream(spark, sf_dir, "SELECT user_id AS k, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS summary FROM events"))
    rows = run_to_end(stream, scratch(spark, "stream-state"))
    return last_update(rows, ["k"]).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
