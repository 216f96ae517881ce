from __future__ import annotations

import json
import threading
from collections.abc import Iterable
from datetime import datetime, timezone
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from runsight.sources.readers import read_json_dir

PROGRESS_SCHEMA = """
    id string, runId string, name string, timestamp string, batchId bigint, batchDuration bigint,
    numInputRows bigint, inputRowsPerSecond double, processedRowsPerSecond double,
    durationMs map<string, bigint>, eventTime map<string, string>,
    stateOperators array<struct<operatorName: string, numRowsTotal: bigint, numRowsUpdated: bigint,
        numRowsRemoved: bigint, memoryUsedBytes: bigint, numRowsDroppedByWatermark: bigint>>,
    sources array<struct<description: string, startOffset: string, endOffset: string, latestOffset: string,
        numInputRows: bigint, inputRowsPerSecond: double, processedRowsPerSecond: double>>,
    sink struct<description: string, numOutputRows: bigint>,
    observedMetrics map<string, map<string, string>>
"""


def progress_key() -> Column:
    """Identifies one progress event: query, batch and time, fit for a file name."""
    return F.concat_ws("_", "id", F.col("batchId").cast("string"), F.replace("timestamp", F.lit(":"), F.lit("-")))


def parse_progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Progress rows of JSON texts."""
    return lines.select(F.inline(F.array(F.from_json(column, PROGRESS_SCHEMA))))


def collect_progress(spark: SparkSession, queries: Iterable[StreamingQuery], first_batch: int = 0) -> DataFrame:
    """The progress events that the queries still hold, without a listener.

    Spark keeps the last events of each query, by default 100. If batches since `first_batch` are gone, that is an error:
    hear longer queries with a `ProgressLog`.
    """
    texts = []
    for query in queries:
        events = query.recentProgress
        batches = sorted({progress.batchId for progress in events})
        if batches and batches != list(range(first_batch, batches[-1] + 1)):
            raise RuntimeError(f"the progress of query {query.name or query.id} begins at batch {batches[0]} or has gaps: events are gone")
        texts += [(progress.json,) for progress in events]
    return parse_progress(spark.createDataFrame(texts, "value string"))


class ProgressLog(StreamingQueryListener):
    """Keeps count of all query events and writes them as JSON lines, `flush_every` progress events at a time.

    What is not written yet is lost with the driver. Events whose write fails wait for the next one. Without a path
    nothing is written and nothing is held. Where no callback connection may be opened, `hear` asks the queries instead.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, flush_every: int = 100):
        self._spark = spark
        self._path = path
        self._flush_every = flush_every
        self._waiting: list[str] = []
        self._lock = threading.Lock()
        self._writing = threading.Lock()
        self._counts = {"started": 0, "progress": 0, "terminated": 0}
        self._names: dict[str, str] = {}
        self._heard: dict[str, int] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self._count("started")
        if event is not None:
            self._names[str(event.id)] = event.name
            self._note("started", event, event.timestamp)

    def onQueryProgress(self, event) -> None:
        self._count("progress")
        if not self._path:
            return
        with self._lock:
            self._waiting.append(event.progress.json)
            due = len(self._waiting) >= self._flush_every
        if due:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._count("terminated")
        if event is not None:
            self._note("terminated", event, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")
        self.flush()

    def hear(self, query: StreamingQuery) -> None:
        """Take what `query` reports of itself: that it runs, its progress, and that it ended. What was heard before isn't taken again.

        Spark holds the last events of a query, by default 100. If some went by unheard, that is an error.
        """
        run, events = str(query.runId), query.recentProgress
        about = SimpleNamespace(id=query.id, runId=query.runId, name=query.name)
        if run not in self._heard:
            about.timestamp = events[0].timestamp if events else datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
            self.onQueryStarted(about)
        before = self._heard.setdefault(run, -1)
        new = [progress for progress in events if progress.batchId > before]
        if new and before >= 0 and new[0].batchId != before + 1:
            raise RuntimeError(f"events of query {query.name or query.id} between batches {before} and {new[0].batchId} are gone")
        for progress in new:
            self.onQueryProgress(SimpleNamespace(progress=progress))
            self._heard[run] = progress.batchId
        if not query.isActive and run not in self._ended:
            self._ended.add(run)
            self.onQueryTerminated(about)

    def _note(self, kind: str, event, timestamp: str) -> None:
        if self._path:
            query = str(event.id)
            line = {"event": kind, "id": query, "runId": str(event.runId), "name": self._names.get(query), "timestamp": timestamp}
            with self._lock:
                self._waiting.append(json.dumps(line))

    def counts(self) -> dict[str, int]:
        """Events seen per kind, and in all."""
        with self._lock:
            return {**self._counts, "total": sum(self._counts.values())}

    def counts_table(self) -> DataFrame:
        """Events seen, as a row per kind."""
        rows = [(kind, seen) for kind, seen in self.counts().items() if kind != "total"]
        return self._spark.createDataFrame(rows, "kind string, events bigint")

    def flush(self) -> int:
        """Write the waiting events; returns how many. They are let go only when they are written."""
        with self._writing:
            with self._lock:
                texts = list(self._waiting)
            if texts and self._path:
                lines = self._spark.createDataFrame([(" ".join(text.split("\n")),) for text in texts], "value string")
                lines.coalesce(1).write.mode("append").text(self._path)
            with self._lock:
                del self._waiting[: len(texts)]
            return len(texts)

    def _count(self, kind: str) -> None:
        with self._lock:
            self._counts[kind] += 1


def register(spark: SparkSession, log: ProgressLog) -> ProgressLog:
    """Let `log` hear all queries of the session."""
    spark.streams.addListener(log)
    return log


def unregister(spark: SparkSession, log: ProgressLog | None) -> None:
    if log is not None:
        spark.streams.removeListener(log)


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """Written progress events, each once, newest first."""
    events = read_json_dir(spark, path, PROGRESS_SCHEMA).filter("id IS NOT NULL AND batchId IS NOT NULL")
    return events.withColumn("_key", progress_key()).dropDuplicates(["_key"]).drop("_key").orderBy(F.col("timestamp").desc())


def progress_by_query(events: DataFrame) -> DataFrame:
    """Batches and input rows per query name."""
    return events.groupBy("name").agg(
        F.countDistinct("batchId").alias("batches"),
        F.sum("numInputRows").alias("input_rows"),
        F.sum(F.col("observedMetrics")["batch"]["rows"].cast("bigint")).alias("counted_rows"),
    )


def batch_counts(events: DataFrame) -> DataFrame:
    """Per query name and batch, the rows read and the rows counted. A batch that was reported several times counts once."""
    return events.groupBy("name", F.col("batchId").alias("batch_id")).agg(
        F.max("numInputRows").alias("input_rows"), F.max(F.col("observedMetrics")["batch"]["rows"].cast("bigint")).alias("counted_rows")
    )


def event_counts(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Events per kind."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("events"))
