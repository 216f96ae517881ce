"""Event-log lines derived from `events`, and the same facts in SQL.

Every event is a finished task. A stage is the index of the event type; its id comes back every day, so the times tell
the runs apart. Stage records span whole days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import load, stored
from runsight.sources import read_event_log
from runsight.sources.staging import scratch_path

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
CLUSTER = "cluster-a"
DAY_MS = 86_400_000
RECORDS_PER_FILE = 100_000
METRIC_KEYS = ("input_metrics__records_read", "executor_cpu_time")
ACCUMULABLE_KEYS = ("number_of_output_rows", "internal_metrics_resultsize")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", spread=True)
    launch = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.array_position(F.lit(EVENT_TYPES), F.col("event_type")) - 1).alias("stage_id"),
        launch.alias("launch"),
        (launch + F.round(F.col("value") * 60000).cast("bigint")).alias("finish"),
    )


def _item(item_id: int, name: str, value) -> F.Column:
    return F.struct(F.lit(item_id).alias("ID"), F.lit(name).alias("Name"), value.cast("string").alias("Value"))


def event_log_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the log lies as compressed text files."""

    def write() -> str:
        path = scratch_path(spark, "event_log")
        # As logs are kept: compressed, and in files that one task reads whole, since such files aren't cut up.
        _lines(spark, sf_dir).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
        return path

    return stored(spark, sf_dir, "event_log_path", write)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, read like any other."""
    return read_event_log(spark, event_log_path(spark, sf_dir), CLUSTER)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    items = F.array(
        _item(17, "number of output rows", F.col("k") * 2),
        _item(5, "Number of Output (rows", F.col("k")),
        _item(9, "peak memory usage", F.lit("12.5")),
        _item(20, "internal.metrics.resultSize", F.when(F.col("event_id") % 3 == 0, F.round(F.col("value") * 100).cast("bigint")).otherwise(100)),
    )
    info = F.struct(
        F.col("event_id").alias("Task ID"),
        F.col("launch").alias("Launch Time"),
        F.col("finish").alias("Finish Time"),
        (F.col("user_id") % 20).cast("string").alias("Executor ID"),
        F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("Host"),
        F.lit("PROCESS_LOCAL").alias("Locality"),
        (F.col("event_id") % 7 == 0).alias("Speculative"),
        items.alias("Accumulables"),
    )
    metrics = F.struct(
        (F.col("event_id") * 7919 % 1000).alias("Executor CPU Time"),
        F.lit(0.5).alias("JVM GC Time"),
        F.lit("7").alias("Result Size"),
        F.struct(F.col("k").alias("Records Read"), F.lit(True).alias("Cached")).alias("Input Metrics"),
    )
    tasks = events.select(
        F.to_json(
            F.struct(
                F.lit("SparkListenerTaskEnd").alias("Event"),
                F.col("stage_id").alias("Stage ID"),
                F.lit(0).alias("Stage Attempt ID"),
                F.when(F.col("event_id") % 2 == 0, "ShuffleMapTask").otherwise("ResultTask").alias("Task Type"),
                F.struct(F.lit("Success").alias("Reason")).alias("Task End Reason"),
                info.alias("Task Info"),
                metrics.alias("Task Metrics"),
            )
        ).alias("logMessage")
    )
    day = F.floor(F.col("launch") / F.lit(DAY_MS))
    stages = (
        events.groupBy("stage_id", day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.to_json(
                F.struct(
                    F.lit("SparkListenerStageCompleted").alias("Event"),
                    F.struct(
                        F.col("stage_id").alias("Stage ID"),
                        F.lit(0).alias("Stage Attempt ID"),
                        F.col("n").alias("Number of Tasks"),
                        (F.col("day") * DAY_MS).alias("Submission Time"),
                        ((F.col("day") + 1) * DAY_MS).alias("Completion Time"),
                    ).alias("Stage Info"),
                )
            ).alias("logMessage")
        )
    )
    return tasks.unionByName(stages)


TASKS_SQL = f"""
tasks AS (
  SELECT event_id AS task_id, user_id, k, value, stage_id, launch, launch + took AS finish, took AS task_time,
         CAST(user_id % 20 AS VARCHAR) AS executor_id, 'host-' || CAST(user_id % 10 AS VARCHAR) AS host,
         CASE WHEN event_id % 2 = 0 THEN 'ShuffleMapTask' ELSE 'ResultTask' END AS task_type,
         event_id * 7919 % 1000 AS cpu, CASE WHEN event_id % 3 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 100 END AS result_size
  FROM (
    SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           CAST(list_position({EVENT_TYPES!r}, event_type) - 1 AS BIGINT) AS stage_id,
           epoch_us(ts) // 1000 AS launch, CAST(round(value * 60000) AS BIGINT) AS took
    FROM events
  )
),
stages AS (
  SELECT stage_id, launch // {DAY_MS} * {DAY_MS} AS submission, (launch // {DAY_MS} + 1) * {DAY_MS} AS completion,
         count(*) AS num_tasks
  FROM tasks GROUP BY ALL
)"""


def joined_sql(grace_ms: int = 30_000) -> str:
    return f"""{TASKS_SQL},
joined AS (
  SELECT t.*, s.submission, s.completion FROM tasks t JOIN stages s
    ON t.stage_id = s.stage_id AND t.launch >= s.submission AND t.finish <= s.completion + {grace_ms}
)"""


def outliers_sql(before: str | None = None) -> str:
    """Rows with flags of the multiples 1 and 2, and scores; with `before`, of tasks and stages that began before it."""
    cut = f"WHERE launch < epoch_ms(TIMESTAMP '{before}') AND submission < epoch_ms(TIMESTAMP '{before}')" if before else ""
    metrics = {"records": "k", "cpu": "cpu", "output": "k * 2", "size": "result_size"}
    stats = ", ".join(f"quantile_cont({column}, 0.95) AS p95_{name}" for name, column in metrics.items())

    def flags(names):
        return " + ".join(
            f"CASE WHEN {metrics[name]} > p95_{name} * {times} THEN 1 ELSE 0 END" for name in names for times in (1, 2)
        )

    return f"""{joined_sql().replace("joined AS", "all_joined AS")},
joined AS (SELECT * FROM all_joined {cut}),
stats AS (
  SELECT stage_id, submission, completion, count(*) AS events, count(DISTINCT task_id) AS num_tasks,
         avg(task_time) AS avg_time, median(task_time) AS median_time, quantile_cont(task_time, 0.95) AS p95_time, {stats}
  FROM joined GROUP BY ALL
),
outliers AS (
  SELECT *, accumulables_score + metrics_score AS overall_score FROM (
    SELECT j.*, s.* EXCLUDE (stage_id, submission, completion),
           CASE WHEN task_time > p95_time * 1 THEN 1 ELSE 0 END AS gt_p95_1,
           CASE WHEN task_time > p95_time * 2 THEN 1 ELSE 0 END AS gt_p95_2,
           CASE WHEN task_time > median_time * 10 THEN 1 ELSE 0 END AS gt_median_10,
           {flags(("output", "size"))} AS accumulables_score,
           {flags(("records", "cpu"))} AS metrics_score
    FROM joined j JOIN stats s USING (stage_id, submission, completion)
  )
)"""
