from __future__ import annotations

import json
import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from runsight.operators import inference
from runsight.operators.inference import keyed_rows, resumable_run
from tests.clients import Counted, Echo, GoesDown


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "why"), (2, "fail"), (3, None), (4, "")], "id int, question string")


def by_id(df, column="answer"):
    return {row["id"]: row[column] for row in df.collect()}


def test_answers_and_errors_are_rows(questions):
    found = by_id(inference.answer(questions, Echo, prompt="question", system_prompt="be brief"))
    assert found[1]["content"] == "system=be brief|user=why []"
    assert (found[1]["completion_tokens"], found[1]["prompt_tokens"], found[1]["total_tokens"]) == (3, 4, 7)
    assert found[1]["status"] == "ok" and found[1]["error_string"] is None and found[1]["latency"] >= 0
    assert found[2].asDict() == {
        "content": None,
        "completion_tokens": 0,
        "prompt_tokens": 0,
        "total_tokens": 0,
        "latency": 0.0,
        "error_string": "no answer",
        "status": "error",
    }
    assert found[3]["status"] == found[4]["status"] == "error"


def test_text_json_and_renamed_fields(questions):
    text = by_id(inference.answer_text(questions, Echo, prompt="question", system_prompt=None))
    assert text == {1: "user=why []", 2: None, 3: None, 4: None}
    answers = by_id(inference.answer_json(questions, Echo, prompt="question"))
    assert json.loads(answers[2])["error_string"] == "no answer"
    assert list(json.loads(answers[1])) == [
        "content", "completion_tokens", "prompt_tokens", "total_tokens", "latency", "error_string", "status",
    ]
    ddl = "output string, c int, p int, t int, l float, error string, status string"
    found = by_id(inference.answer(questions, Echo, prompt="question", schema=ddl))
    assert found[2]["error"] == "no answer" and found[1]["output"].startswith("system=")
    with pytest.raises(ValueError):
        inference.answer(questions, Echo, prompt="question", schema="one string")


def test_prompt_or_messages(questions):
    for wrong in ({}, {"prompt": "question", "messages": "question"}):
        with pytest.raises(ValueError):
            inference.answer(questions, Echo, **wrong)


def test_messages_are_sent_as_they_are(spark):
    turns = spark.createDataFrame(
        [(1, 2, "user", "third"), (1, 0, "system", "first"), (1, 1, "assistant", "second"), (2, 0, "user", "only")],
        "id int, turn int, role string, content string",
    )
    conversations = inference.assemble_messages(turns, conversation="id")
    found = by_id(inference.answer_text(conversations, Echo, messages="messages"))
    assert found == {1: "system=first|assistant=second|user=third []", 2: "user=only []"}


def test_request_params(spark):
    df = spark.createDataFrame([(1, "q", "big", None), (2, "q", None, 5)], "id int, question string, model string, most int")
    df = inference.with_request_params(
        df, {"model": "m", "temperature": 0, "max_tokens": 9}, {"model": "model", "max_tokens": F.col("most")}
    )
    found = by_id(inference.answer_text(df, Echo, prompt="question", params="request_params", system_prompt=None))
    assert found[1] == "user=q [('max_tokens', 9), ('model', 'big'), ('temperature', 0.0)]"
    assert found[2] == "user=q [('max_tokens', 5), ('model', 'm'), ('temperature', 0.0)]"


def test_replicate(questions):
    assert inference.replicate(questions, 11).count() == 8
    assert inference.replicate(questions, 3).count() == 0
    assert inference.replicate(questions, 400, rows=4).columns == questions.columns
    plan = inference.replicate(questions, 400, rows=4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_labelled_runs(spark, questions):
    run = inference.labelled_run(questions, 3, Echo, "runs_a", label="one")
    assert run["run_time"] > 0
    counts = {(r["test_label"], r["status"]): r["count"] for r in run["status_counts"].collect()}
    assert counts == {("one", "ok"): 1, ("one", "error"): 3}
    swept = inference.sweep(questions, [1, 2], Echo, "runs_a", label="s")
    assert {(r["parallelism"], r["status"], r["count"]) for r in swept.collect()} == {
        (1, "ok", 1), (1, "error", 3), (2, "ok", 1), (2, "error", 3),
    }
    every = inference.status_counts(spark.table("runs_a"))
    assert every.count() == 6
    unlabelled = inference.labelled_run(questions, 2, Echo, "runs_a")
    assert unlabelled["label"].endswith("parallelism=2")
    peaks = inference.peak_concurrency(
        spark.table("runs_a").select("test_label", "answer.started_ms", "answer.finished_ms"), "started_ms", "finished_ms"
    )
    assert peaks.count() == 4 and all(0 <= r["peak_concurrency"] <= 3 for r in peaks.collect())


def brute_peak(calls):
    points = sorted({t for call in calls for t in call})
    return max(sum(a <= t < b for a, b in calls) for t in points)


def test_peak_concurrency(spark):
    import random

    rng = random.Random(5)
    data = {k: [(a := rng.randrange(0, 5000), a + rng.randrange(0, 900)) for _ in range(200)] for k in "xy"}
    df = spark.createDataFrame([(k, a, b) for k, calls in data.items() for a, b in calls], "k string, a bigint, b bigint")
    for slot in (50, 700, 60_000):
        found = {r["k"]: r["peak_concurrency"] for r in inference.peak_concurrency(df, "a", "b", ["k"], slot).collect()}
        assert found == {k: brute_peak(calls) for k, calls in data.items()}


@pytest.mark.parametrize("use", ["filter", "take apart", "text", "join"])
def test_the_service_is_called_once_per_row(spark, tmp_path, use):
    notes = tmp_path / "calls"
    rows = spark.range(100).selectExpr("id", "concat('q', id) AS question")
    make = partial(Counted, str(notes))
    if use == "text":
        found = inference.answer_text(rows, make, prompt="question").filter("answer IS NOT NULL")
    else:
        found = inference.answer(rows, make, prompt="question")
        found = {"filter": lambda: found.filter("answer.status = 'ok'"), "take apart": lambda: found.select("answer.*").filter("status = 'ok'"), "join": lambda: found.filter("answer.status = 'ok'").join(spark.range(100), "id")}[use]()
    assert found.count() == found.filter("true").count() == 100
    found.collect()
    assert len(notes.read_text()) == 300
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ask(") == 1


def test_sweeps_into_one_table_and_labels_are_new(spark, questions):
    first, second = (inference.sweep(questions, [1, 2], Echo, "runs_again", label="s").collect() for _ in range(2))
    assert sorted((r["parallelism"], r["status"], r["count"]) for r in second) == sorted((r["parallelism"], r["status"], r["count"]) for r in first)
    assert {r["test_label"] for r in first}.isdisjoint(r["test_label"] for r in second)
    table = spark.table("runs_again")
    assert table.count() == table.select("test_label", "row_id").distinct().count() == 16
    inference.labelled_run(questions, 1, Echo, "runs_again", label="mine")
    with pytest.raises(ValueError, match="mine"):
        inference.labelled_run(questions, 1, Echo, "runs_again", label="mine")


def test_rows_have_keys_of_what_they_hold(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), (None, None), (None, None), (None, None), ("", 0)]
    df = spark.createDataFrame(rows, "q string, n int")
    keys = [sorted(map(tuple, keyed_rows(part, block=block).collect()), key=repr) for part, block in ((df.repartition(5), 2), (df.coalesce(1), 100))]
    assert keys[0] == keys[1] and len({key for *_, key in keys[0]}) == 7
    assert sorted(row[:2] for row in keys[0] if row[0]) == [("a", 1), ("a", 1), ("b", 1)]
    assert keyed_rows(df.limit(0)).collect() == []


def test_a_run_that_broke_off_asks_for_what_is_missing(spark, tmp_path):
    rows = [(f"question {i % 80}",) for i in range(100)] + [("fail",), (None,)]
    df = spark.createDataFrame(rows, "question string").repartition(3)
    notes, table = str(tmp_path / "calls"), "resumed_answers"
    open(notes, "w").close()
    calls = lambda: os.path.getsize(notes)
    with pytest.raises(Exception, match="Outage"):
        resumable_run(df, partial(GoesDown, notes, 60), table, "run", slices=8, parallelism=1)
    kept = spark.table(table).count()
    assert 0 < kept <= 61 and calls() == 60
    before = calls()
    done = resumable_run(df.repartition(7), partial(Counted, notes), table, "run", slices=8)
    assert done.count() == 102 == done.select("row_key").distinct().count()
    # One row has no prompt, and no call.
    assert calls() - before in (102 - kept, 101 - kept)
    assert sorted(r["question"] or "" for r in done.collect()) == sorted(row[0] or "" for row in rows)
    before = calls()
    assert resumable_run(df, partial(Counted, notes), table, "run", slices=3).count() == 102 and calls() == before
    more = df.union(df.limit(1))
    assert resumable_run(more, partial(Counted, notes), table, "run", slices=3).count() == 103 and calls() <= before + 1
    assert resumable_run(df, partial(Counted, notes), table, "other", slices=2).count() == 102
    assert spark.table(table).count() == 205


def test_a_run_without_rows(spark):
    df = spark.createDataFrame([], "question string")
    assert resumable_run(df, Echo, "no_answers", "run", slices=2).collect() == []


def test_few_tasks_answer_many_rows_in_rounds(spark):
    rows = spark.range(0, 3000, 1, 12).selectExpr("id", "concat('q', id) AS question")
    inference.labelled_run(rows, 2, Echo, "runs_in_rounds", label="one")
    inference.labelled_run(rows, 2, Echo, "runs_in_rounds", label="many", task_bytes=4_000)
    table = spark.table("runs_in_rounds")
    files = {r["test_label"]: r["n"] for r in table.groupBy("test_label").agg(F.countDistinct("_metadata.file_path").alias("n")).collect()}
    assert files["one"] == 2 and files["many"] > 6
    for label in ("one", "many"):
        run = table.filter(F.col("test_label") == label)
        assert run.count() == run.select("row_id").distinct().count() == run.select("id").distinct().count() == 3000
    swept = inference.sweep(rows, [1, 3], Echo, "runs_in_rounds", label="s", task_bytes=4_000).collect()
    assert {(r["parallelism"], r["count"]) for r in swept} == {(1, 3000), (3, 3000)}
    assert inference.sweep(rows.limit(0), [2], Echo, "runs_in_rounds", label="empty").count() == 0
