"""Queries of the streaming operators: a file stream of `events`, and the progress of the queries over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks.log_fixture import CLUSTER, DAY_MS, EVENT_TYPES, event_log, joined_sql
from checks.tables import load, stored
from runsight import streaming
from runsight.sources.staging import scratch_path, stage


def _streams(spark: SparkSession, sf_dir: str) -> list:
    """Two named queries over the whole table, run to their end: all events, and the purchases."""
    schema = load(spark, sf_dir, "events").schema
    stream = streaming.event_stream(spark, sf_dir, schema, name_filter="events.parquet")
    run = uuid.uuid4().hex[:8]
    queries = [
        streaming.run_counted(stream, f"all-{run}"),
        streaming.run_counted(stream.filter(F.col("event_type") == "purchase"), f"purchases-{run}"),
    ]
    for query in queries:
        query.awaitTermination()
    return queries


def _with_data(events: DataFrame) -> DataFrame:
    return events.withColumn("name", F.split("name", "-")[0]).filter(F.col("numInputRows") > 0)


def _progress_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.progress_by_query(_with_data(streaming.collect_progress(spark, _streams(spark, sf_dir))))


def _parts(spark: SparkSession, sf_dir: str) -> str:
    """The table in parts, by event type."""

    def write() -> str:
        path = scratch_path(spark, "event_parts")
        load(spark, sf_dir, "events").repartition("event_type").sortWithinPartitions("event_id").write.partitionBy("event_type").parquet(path)
        return path

    return stored(spark, sf_dir, "event_parts", write)


def _in_two_runs(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], StreamingQuery], between: Callable[[StreamingQuery], None]) -> None:
    """A query over the parts as they arrive, one file per batch: it ends when it has read the first two, and is started again for the rest."""
    table, arrived = load(spark, sf_dir, "events"), scratch_path(spark, "arrived")
    parts = spark.read.parquet(_parts(spark, sf_dir))
    for types in (EVENT_TYPES[:2], EVENT_TYPES[2:]):
        for event_type in types:
            # One part is one file, and one batch.
            parts.filter(F.col("event_type") == event_type).select(*table.columns).coalesce(1).write.mode("append").parquet(arrived)
        query = start(streaming.event_stream(spark, arrived, table.schema, name_filter="*.parquet", files_per_batch=1))
        query.awaitTermination()
        between(query)


def _heard(spark: SparkSession, sf_dir: str, log: streaming.ProgressLog) -> streaming.ProgressLog:
    """The log hears what both queries report; so no callback port is opened."""
    for query in _streams(spark, sf_dir):
        log.hear(query)
    return log


def _progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress written by two listeners to one folder, so each event twice, and read back once."""
    path = scratch_path(spark, "progress")
    queries = _streams(spark, sf_dir)
    for flush_every in (1, 2):
        log = streaming.ProgressLog(spark, path, flush_every=flush_every)
        for query in queries:
            log.hear(query)
        log.flush()
    events = _with_data(streaming.progress_table(spark, path))
    return streaming.progress_by_query(events).drop("batches")


def _listener_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries of two runs each, one batch per part. Two logs write what they hear to one folder; its events are counted by a
    stream that is itself started anew after each run."""
    path, counted, checkpoint = (scratch_path(spark, name) for name in ("events_heard", "events_counted", "counter"))
    logs = [streaming.ProgressLog(spark, path, flush_every=n) for n in (1, 100)]

    def hear(query: StreamingQuery) -> None:
        for log in logs:
            log.hear(query)
            log.flush()
        streaming.count_events(spark, path, counted, checkpoint).awaitTermination()

    for name, only in (("all", F.lit(True)), ("purchases", F.col("event_type") == "purchase")):
        own = scratch_path(spark, f"stream_{name}")
        _in_two_runs(spark, sf_dir, lambda stream: streaming.run_counted(stream.filter(only), name, checkpoint=own), hear)
    # How many rows count as read depends on what the reader can skip.
    return streaming.event_totals(spark, counted).drop("input_rows")


def _kept_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a stream has kept in two runs, and the rows that its batches report."""
    path, own = scratch_path(spark, "kept"), scratch_path(spark, "stream_kept")
    reported = []

    def hear(query: StreamingQuery) -> None:
        reported.append(stage(streaming.collect_progress(spark, [query], query.recentProgress[0].batchId), "batches"))

    _in_two_runs(spark, sf_dir, lambda stream: streaming.run_kept(stream, "kept", path, own, partition_by=["event_type"]), hear)
    batches = streaming.batch_counts(reported[0].unionByName(reported[1])).filter("input_rows > 0")
    kept = spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum("user_id").alias("users"))
    of_batch = F.transform(F.array(*map(F.lit, EVENT_TYPES)), lambda x, i: F.struct(x.alias("event_type"), i.cast("long").alias("batch_id")))
    numbered = spark.range(1).select(F.inline(of_batch))
    return kept.join(numbered, "event_type").join(batches, "batch_id").select("event_type", "n", "ids", "users", "input_rows", "counted_rows")


LOG_PARTS = 5


def _growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their stages, from a log that is written in five parts, by time, and read part by part."""
    log, path = event_log(spark, sf_dir).select("logMessage"), scratch_path(spark, "growing_log")
    place = [F.get_json_object("logMessage", name).cast("long") for name in ("$['Task Info']['Launch Time']", "$['Stage Info']['Completion Time']")]
    timed = stage(log.withColumn("_at", F.coalesce(*place)), "timed_log")
    first, last = timed.agg(F.min("_at"), F.max("_at")).first()
    own, kept = scratch_path(spark, "stream_log"), scratch_path(spark, "growing_tasks")
    for part in range(LOG_PARTS if first is not None else 0):
        low, high = (first + (last + 1 - first) * k // LOG_PARTS for k in (part, part + 1))
        # Each task of the table writes what it has of the part; all these files are one batch.
        timed.filter((F.col("_at") >= low) & (F.col("_at") < high)).select("logMessage").write.mode("append").option("compression", "gzip").text(path)
        # Started anew for each part: what waits for its partner is in the state store.
        stream = streaming.event_log_stream(spark, path, CLUSTER)
        joined = streaming.attach_stages_stream(stream, grace_ms=1_800_000, longest_ms=2 * DAY_MS, late="2 days")
        streaming.run_kept(joined, "growing log", kept, own).awaitTermination()
    return spark.read.parquet(kept).select("task_id", "stage_id", "stage__submission_time", "stage__completion_time", "stage__num_tasks")


def _event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.event_counts(load(spark, sf_dir, "events"), "event_type")


QUERIES = {
    "progress_by_query": _progress_by_query,
    "progress_table": _progress_table,
    "listener_counts": _listener_counts,
    "stream_event_counts": _event_counts,
    "stream_kept_batches": _kept_batches,
    "stream_attach_stages": _growing_log,
}

_ROWS = """SELECT 'all' AS name, CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) AS BIGINT) AS counted_rows FROM events
UNION ALL SELECT 'purchases', count(*), count(*) FILTER (event_type = 'purchase') FROM events"""

ATTACH_STAGES_SQL = f"""WITH {joined_sql(1_800_000)}
SELECT task_id, j.stage_id, j.submission AS stage__submission_time, j.completion AS stage__completion_time,
  s.num_tasks AS stage__num_tasks FROM joined j JOIN stages s USING (stage_id, submission)"""

ORACLE = {
    "progress_by_query": f"SELECT *, CAST(1 AS BIGINT) AS batches FROM ({_ROWS})",
    "progress_table": _ROWS,
    # As many batches as there are parts, and two runs.
    "listener_counts": """WITH parts AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL),
named AS (SELECT 'all' AS name, count(*) AS batches, CAST(sum(n) AS BIGINT) AS counted_rows FROM parts
  UNION ALL SELECT 'purchases', count(*), CAST(sum(n) FILTER (event_type = 'purchase') AS BIGINT) FROM parts)
SELECT name, 'progress' AS kind, batches AS events, batches, counted_rows FROM named
UNION ALL SELECT name, kind, CAST(2 AS BIGINT), NULL, NULL FROM named, (VALUES ('started'), ('terminated')) AS k(kind)""",
    "stream_event_counts": "SELECT event_type, count(*) AS events FROM events GROUP BY ALL",
    "stream_kept_batches": """SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(user_id) AS BIGINT) AS users,
  count(*) AS input_rows, count(*) AS counted_rows FROM events GROUP BY ALL""",
    "stream_attach_stages": ATTACH_STAGES_SQL,
}
