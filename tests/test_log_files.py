"""The event log that the queries read, as files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from checks import log_fixture, stream_queries


@pytest.fixture
def tables(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 120).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 50).alias("user_id"),
        F.element_at(F.array(*map(F.lit, log_fixture.EVENT_TYPES)), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 90 / 10.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 7, F.lit("}")).alias("props"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_the_log_is_compressed_and_cut_into_files(spark, tables, monkeypatch):
    monkeypatch.setattr(log_fixture, "RECORDS_PER_FILE", 100)
    path = log_fixture.event_log_path(spark, tables).removeprefix("file:")
    names = [name for name in os.listdir(path) if name.startswith("part-")]
    assert len(names) >= 40 and all(name.endswith(".gz") for name in names)
    assert log_fixture.event_log(spark, tables).filter(F.col("logMessage").contains("SparkListenerTaskEnd")).count() == 4000


def test_many_tasks_write_each_part_of_the_growing_log(spark, tables, monkeypatch):
    monkeypatch.setattr(log_fixture, "RECORDS_PER_FILE", 100)
    paths = set()
    stream = stream_queries.streaming.event_log_stream

    def noted(spark, path, *rest, **options):
        paths.add(path)
        return stream(spark, path, *rest, **options)

    monkeypatch.setattr(stream_queries.streaming, "event_log_stream", noted)
    found = stream_queries.QUERIES["stream_attach_stages"](spark, tables)
    # A task at midnight may fit the stages of both days.
    assert found.count() >= found.select("task_id").distinct().count() == 4000
    (path,) = paths
    assert sum(name.startswith("part-") for name in os.listdir(path.removeprefix("file:"))) > 2 * stream_queries.LOG_PARTS
