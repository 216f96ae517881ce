from __future__ import annotations

import json
import random
from types import SimpleNamespace

import pytest

from runsight import streaming
from runsight.operators.events import parse_records, stage_rows, task_rows
from runsight.operators.windows import attach_stages
from runsight.sources import read_event_log


def event(query, batch, rows=5, second=0):
    body = {
        "id": query,
        "runId": "r",
        "name": f"name-{query}",
        "timestamp": f"2024-01-01T00:00:{second:02d}.000Z",
        "batchId": batch,
        "numInputRows": rows,
        "durationMs": {"addBatch": 3},
        "sources": [{"description": "s", "startOffset": {"a": 1}, "numInputRows": rows}],
        "sink": {"description": "k", "numOutputRows": -1},
        "observedMetrics": {"batch": {"rows": rows}},
    }
    return SimpleNamespace(progress=SimpleNamespace(json=json.dumps(body, indent=1)))


def test_events_are_written_in_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    log = streaming.ProgressLog(spark, path, flush_every=2)
    log.onQueryStarted(None)
    for batch in range(3):
        log.onQueryProgress(event("q", batch, second=batch))
    assert streaming.progress_table(spark, path).count() == 2
    log.onQueryTerminated(None)
    assert streaming.progress_table(spark, path).count() == 3
    assert log.counts() == {"started": 1, "progress": 3, "terminated": 1, "total": 5}
    assert log.flush() == 0


def test_without_a_path_nothing_is_held(spark):
    log = streaming.ProgressLog(spark)
    log.onQueryProgress(event("q", 0))
    log.onQueryTerminated(None)
    assert log.flush() == 0 and log.counts()["progress"] == 1


def test_table_is_deduplicated_newest_first_and_skips_bad_files(spark, tmp_path):
    path = tmp_path / "log"
    log = streaming.ProgressLog(spark, str(path), flush_every=1)
    for query, batch, second in (("a", 0, 1), ("b", 0, 2), ("a", 1, 3), ("a", 0, 1)):
        log.onQueryProgress(event(query, batch, second=second))
    (path / "bad.json").write_text('{"id": "x", "batchId":')
    (path / "bad.json.gz").write_bytes(b"\x1f\x8b\x08garbage")
    table = streaming.progress_table(spark, str(path))
    assert [(r["id"], r["batchId"]) for r in table.collect()] == [("a", 1), ("b", 0), ("a", 0)]
    row = table.first()
    assert row["durationMs"] == {"addBatch": 3} and json.loads(row["sources"][0]["startOffset"]) == {"a": 1}
    key = table.select(streaming.progress_key()).first()[0]
    assert key == "a_1_2024-01-01T00-00-03.000Z"
    counts = {r["name"]: (r["batches"], r["input_rows"], r["counted_rows"]) for r in streaming.progress_by_query(table).collect()}
    assert counts == {"name-a": (2, 10, 10), "name-b": (1, 5, 5)}


def test_streams_are_counted_by_name(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), "id bigint", "*.parquet", files_per_batch=1)
    queries = [streaming.run_counted(stream, "every"), streaming.run_counted(stream.filter("id % 2 = 0"), "even")]
    for query in queries:
        query.awaitTermination()
    events = streaming.collect_progress(spark, queries).filter("numInputRows > 0")
    found = {r["name"]: (r["batches"], r["input_rows"], r["counted_rows"]) for r in streaming.progress_by_query(events).collect()}
    assert found == {"every": (3, 30, 30), "even": (3, 30, 15)}


def test_rate_stream_and_interval(spark):
    stream = streaming.rate_stream(spark, 50)
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]
    query = streaming.run_counted(stream, "rate", every="200 milliseconds")
    try:
        for _ in range(100):
            if any(p.numInputRows for p in query.recentProgress):
                break
            query.awaitTermination(1)
        assert any(p.numInputRows for p in query.recentProgress)
    finally:
        query.stop()


def test_event_counts(spark):
    df = spark.createDataFrame([("started",), ("progress",), ("progress",)], "kind string")
    assert {r["kind"]: r["events"] for r in streaming.event_counts(df).collect()} == {"started": 1, "progress": 2}


def test_unregister_without_a_log(spark):
    streaming.unregister(spark, None)


@pytest.mark.parametrize("flush_every", [1, 3])
def test_each_event_is_written_once(spark, tmp_path, flush_every):
    log = streaming.ProgressLog(spark, str(tmp_path / "l"), flush_every)
    for batch in range(4):
        log.onQueryProgress(event("q", batch))
    log.flush()
    assert spark.read.text(str(tmp_path / "l")).count() == 4


def test_events_wait_if_their_write_fails(spark, tmp_path):
    path = str(tmp_path / "l")
    log = streaming.ProgressLog(spark, path, flush_every=100)
    for batch in range(3):
        log.onQueryProgress(event("q", batch))
    log._path = "no-such-scheme://x/y"
    with pytest.raises(Exception):
        log.flush()
    log._path = path
    log.onQueryProgress(event("q", 3))
    assert log.flush() == 4 and log.flush() == 0
    assert spark.read.text(path).count() == 4
    assert {r["kind"]: r["events"] for r in log.counts_table().collect()} == {"started": 0, "progress": 4, "terminated": 0}


def test_lost_progress_is_an_error(spark):
    def query(*batches):
        return SimpleNamespace(name="n", id="i", recentProgress=[SimpleNamespace(batchId=b, json=event("q", b).progress.json) for b in batches])

    assert streaming.collect_progress(spark, [query(0, 1, 1, 2), query()]).count() == 4
    assert streaming.collect_progress(spark, [query(5, 6)], first_batch=5).count() == 2
    for batches in ((3, 4), (0, 2)):
        with pytest.raises(RuntimeError, match="gone"):
            streaming.collect_progress(spark, [query(*batches)])


def lines_of(path):
    return [json.loads(line) for file in sorted(path.glob("*")) if not file.name.startswith((".", "_")) for line in file.read_text().splitlines()]


def queries_of(spark, tmp_path, parts, name, checkpoint, keep=None):
    """A query over a folder that gets `parts` more files, run to its end."""
    for n in parts:
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), "id bigint", "*.parquet", files_per_batch=1)
    query = streaming.run_kept(stream, name, keep, checkpoint) if keep else streaming.run_counted(stream, name, checkpoint=checkpoint)
    query.awaitTermination()
    return query


def test_a_log_hears_each_event_once(spark, tmp_path):
    log = streaming.ProgressLog(spark, str(tmp_path / "log"), flush_every=2)
    query = queries_of(spark, tmp_path, range(3), "heard", str(tmp_path / "c"))
    for _ in range(2):
        log.hear(query)
    assert log.counts() == {"started": 1, "progress": 3, "terminated": 1, "total": 5}
    again = queries_of(spark, tmp_path, range(3, 5), "heard", str(tmp_path / "c"))
    log.hear(again)
    assert log.counts() == {"started": 2, "progress": 5, "terminated": 2, "total": 9}
    lines = lines_of(tmp_path / "log")
    assert sum("event" in line for line in lines) == 4 and {line["name"] for line in lines} == {"heard"}
    assert streaming.progress_table(spark, str(tmp_path / "log")).count() == 5


def test_events_that_went_by_unheard_are_an_error(spark):
    def query(*batches):
        events = [SimpleNamespace(batchId=b, timestamp="t", json=event("q", b).progress.json) for b in batches]
        return SimpleNamespace(id="i", runId="r", name="n", recentProgress=events, isActive=True)

    log = streaming.ProgressLog(spark)
    log.hear(query(0, 1))
    log.hear(query(0, 1, 2))
    assert log.counts()["progress"] == 3 and log.counts()["terminated"] == 0
    with pytest.raises(RuntimeError, match="between batches 2 and 5"):
        log.hear(query(5, 6))


def test_counts_outlive_restarts_and_leave_out_copies(spark, tmp_path):
    path, counted, own = (str(tmp_path / name) for name in ("log", "counted", "own"))
    logs = [streaming.ProgressLog(spark, path, flush_every=n) for n in (1, 100)]
    for run, parts in enumerate((range(3), range(3, 7)), 1):
        query = queries_of(spark, tmp_path, parts, "counted", str(tmp_path / "c"))
        for log in logs:
            log.hear(query)
        for _ in range(2):
            # The second time there is nothing new.
            streaming.count_events(spark, path, counted, own, files_per_batch=2).awaitTermination()
        rows = {r["kind"]: (r["events"], r["batches"], r["input_rows"], r["counted_rows"]) for r in streaming.event_totals(spark, counted).collect()}
        seen = parts[-1] + 1
        assert rows == {"started": (run, None, None, None), "terminated": (run, None, None, None), "progress": (seen, seen, 10 * seen, 10 * seen)}
    (tmp_path / "log" / "bad.json").write_text('{"id": "x", "batchId":\n{"other": 1}\n')
    streaming.count_events(spark, path, counted, own).awaitTermination()
    assert sum(r["events"] for r in streaming.event_totals(spark, counted).collect()) == 11


def test_counted_events_within_the_watermark_may_come_in_any_order(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    order = [5, 3, 4, 3, 5, 1]
    for n, batch in enumerate(order):
        (path / f"{n}.json").write_text(" ".join(event("q", batch, second=batch).progress.json.split("\n")))
        streaming.count_events(spark, str(path), str(tmp_path / "counted"), str(tmp_path / "own"), late="1 minute").awaitTermination()
    row = streaming.event_totals(spark, str(tmp_path / "counted")).first()
    assert (row["events"], row["batches"], row["input_rows"]) == (4, 4, 20)


def test_a_kept_stream_that_is_stopped_between_batches_holds_each_row_once(spark, tmp_path):
    for n in range(6):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), "id bigint", "*.parquet", files_per_batch=1)
    keep, own, events = str(tmp_path / "kept"), str(tmp_path / "c"), []
    query = streaming.run_kept(stream, "kept", keep, own, every="100 milliseconds")
    for _ in range(200):
        if query.recentProgress:
            break
        query.awaitTermination(0.1)
    query.stop()
    events.append(streaming.collect_progress(spark, [query]))
    done = spark.read.parquet(keep).count()
    assert 10 <= done <= 60
    # What a batch that was cut short has left behind is in no batch.
    spark.range(1000, 1005).coalesce(1).write.parquet(str(tmp_path / "left"))
    for file in (tmp_path / "left").glob("part-*"):
        (tmp_path / "kept" / file.name).write_bytes(file.read_bytes())
    query = streaming.run_kept(stream, "kept", keep, own)
    query.awaitTermination()
    events.append(streaming.collect_progress(spark, [query], query.recentProgress[0].batchId if query.recentProgress else 0))
    assert sorted(r["id"] for r in spark.read.parquet(keep).collect()) == list(range(60))
    counts = streaming.batch_counts(events[0].unionByName(events[1])).filter("input_rows > 0").collect()
    assert sorted(r["batch_id"] for r in counts) == list(range(6)) and {r["counted_rows"] for r in counts} == {10}


def record(kind, **about):
    if kind == "task":
        info = {"Task ID": about["task"], "Launch Time": about["launch"], "Finish Time": about["finish"], "Executor ID": "1", "Host": "h"}
        return json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": about["stage"], "Task Type": "T", "Task Info": info})
    info = {"Stage ID": about["stage"], "Stage Attempt ID": 0, "Number of Tasks": 1, "Submission Time": about["since"], "Completion Time": about["until"]}
    return json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": info})


def test_a_growing_log_gives_what_the_whole_log_gives(spark, tmp_path):
    dice, minute = random.Random(3), 60_000
    lines = []
    for n in range(60):
        # Stage ids come back, and some runs overlap.
        since = n * 7 * minute
        until = since + dice.randint(1, 20) * minute
        lines.append((until, record("stage", stage=n % 4, since=since, until=until)))
        for k in range(5):
            launch = since + dice.randint(-1, 10) * minute
            finish = launch + dice.randint(0, 10) * minute
            lines.append((finish + dice.randint(-9, 9) * minute, record("task", task=n * 10 + k, stage=n % 4, launch=launch, finish=finish)))
    lines.append((0, "not a record"))
    texts = [text for _, text in sorted(lines)]
    path = tmp_path / "log"
    path.mkdir()
    options = {"grace_ms": minute, "slot_ms": 5 * minute}
    for n in range(5):
        (path / f"{n}.txt").write_text("\n".join(texts[n * len(texts) // 5 : (n + 1) * len(texts) // 5]))
        stream = streaming.event_log_stream(spark, str(path), "c", files_per_batch=1)
        joined = streaming.attach_stages_stream(stream, longest_ms=30 * minute, late="1 hour", **options)
        query = streaming.run_kept(joined, "log", str(tmp_path / "kept"), str(tmp_path / "c"))
        query.awaitTermination()
    held = [operator.numRowsTotal for operator in query.recentProgress[-1].stateOperators]
    assert held and sum(held) < len(lines)
    raw = read_event_log(spark, str(path), "c")
    parsed = parse_records(raw, metric_keys=(), accumulable_keys=())
    whole = attach_stages(task_rows(parsed), stage_rows(parsed), grace_ms=minute, slot_ms=5 * minute, split_rows=None)
    columns = ["task_id", "stage_id", "task_launch_time", "stage__submission_time", "stage__completion_time", "stage__num_tasks", "event_time"]
    found, expected = (sorted(map(tuple, df.select(*columns).collect())) for df in (spark.read.parquet(str(tmp_path / "kept")), whole))
    assert found == expected and len(found) > 150


def test_a_stage_that_runs_too_long_for_the_state_is_an_error(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.txt").write_text("\n".join([record("stage", stage=1, since=0, until=10**9), record("task", task=1, stage=1, launch=1, finish=2)]))
    joined = streaming.attach_stages_stream(streaming.event_log_stream(spark, str(tmp_path / "log"), "c"), longest_ms=10**8)
    with pytest.raises(Exception, match="runs longer"):
        streaming.run_kept(joined, "long", str(tmp_path / "kept"), str(tmp_path / "c")).awaitTermination()
