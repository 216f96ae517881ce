"""Queries of the inference operators, with a local client."""

from __future__ import annotations

import hashlib
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_code
from checks.tables import load
from runsight.operators import inference
from runsight.sources import read_prompts
from runsight.sources.staging import scratch_path

DEFAULTS = {"model": "small", "temperature": 0.0, "max_tokens": 1024}


class DigestClient:
    """Answers with the digest of the last message; refuses some lengths."""

    def complete(self, messages: list[dict[str, str]], params: dict[str, Any]) -> inference.Completion:
        text = messages[-1]["content"]
        if len(text) % 7 == 0:
            raise ValueError(f"refused {len(text)}")
        digest = hashlib.md5(text.encode()).hexdigest()
        return inference.Completion(f"{params.get('model') or 'none'}:{digest}", len(messages), len(text))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return load(spark, sf_dir, "documents", spread=True).select("doc_id", "lang", "text")


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.answer_text(_documents(spark, sf_dir), DigestClient, prompt="text").drop("text")


def _struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = inference.answer(_documents(spark, sf_dir), DigestClient, prompt="text")
    return answered.select("doc_id", "answer.*").drop("latency")


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "output string, completion_tokens int, prompt_tokens int, total_tokens int, latency float, error string, status string"
    answered = inference.answer(_documents(spark, sf_dir), DigestClient, prompt="text", schema=schema)
    return answered.groupBy("answer.status").agg(
        F.count("answer.output").alias("outputs"), F.count("answer.error").alias("errors")
    )


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = inference.answer_json(_documents(spark, sf_dir), DigestClient, prompt="text")
    field = F.get_json_object
    return answered.select(
        "doc_id",
        field("answer", "$.content").alias("content"),
        field("answer", "$.total_tokens").cast("int").alias("total_tokens"),
        field("answer", "$.error_string").alias("error_string"),
        F.size(F.json_object_keys("answer")).alias("fields"),
    )


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).withColumn("wanted", F.when(F.col("lang") == "fr", "large"))
    documents = inference.with_request_params(documents, DEFAULTS, {"model": "wanted"})
    answered = inference.answer_text(documents, DigestClient, prompt="text", params="request_params")
    return answered.select("doc_id", "request_params.*", "answer")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    turns = load(spark, sf_dir, "conversations", spread=True)
    conversations = inference.assemble_messages(turns, content="text")
    answered = inference.answer(conversations, DigestClient, messages="messages")
    joined = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return answered.select("conv_id", joined.alias("dialogue"), "answer.completion_tokens", "answer.status")


def _replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = load(spark, sf_dir, "benchmark").select("item_id", F.trim("text").alias("question"))
    copies = inference.replicate(prompts, 6000)
    return copies.groupBy("item_id").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("question")).alias("chars"))


def _run_table(spark: SparkSession) -> dict[str, str]:
    name = f"answers_{uuid.uuid4().hex}"
    return {"results_table": name, "path": scratch_path(spark, name)}


def _status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _run_table(spark)
    documents = _documents(spark, sf_dir)
    for label, parallelism in (("first", 4), ("second", 8)):
        inference.labelled_run(documents, parallelism, DigestClient, label=label, prompt="text", **table)
    return inference.status_counts(spark.table(table["results_table"]))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    table = _run_table(spark)
    for _ in range(2):  # the second sweep's counts must not hold the first one's rows
        rows = inference.sweep(documents, [2, 4, 8], DigestClient, prompt="text", **table)
    # Labels hold the time.
    return rows.drop("run_time_s").withColumn("test_label", F.regexp_replace("test_label", r"_\d{8}_\d{6}_\d{6} ", " "))


class Down(BaseException):
    """The service is gone: this ends the call's task, not only its row."""


class FailingClient(DigestClient):
    """Goes down at some texts."""

    def complete(self, messages: list[dict[str, str]], params: dict[str, Any]) -> inference.Completion:
        if hashlib.md5(messages[-1]["content"].encode()).digest()[0] == 0:
            raise Down
        return super().complete(messages, params)


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document twice, answered by a service that goes down, then by one that doesn't: what was stored isn't asked for again."""
    table = _run_table(spark)
    documents = _documents(spark, sf_dir)
    twice = documents.union(documents)
    options = {"label": "run", "slices": 6, "prompt": "text", "stored": ["doc_id"], **table}
    try:
        inference.resumable_run(twice, FailingClient, **options)
    except Exception as error:
        # Any other failure is one.
        if "Down" not in str(error):
            raise
    answers = inference.resumable_run(twice, DigestClient, **options)
    return answers.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("answers"), F.countDistinct("row_key").alias("row_keys"), F.countDistinct("answer.content").alias("contents"), F.min("answer.content").alias("content")
    )


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = inference.answer(_documents(spark, sf_dir), DigestClient, prompt="text")
    return answered.filter("answer.status = 'ok'").select("doc_id", "answer.content", "answer.total_tokens")


def _prompts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts written one per line and read back."""
    path = scratch_path(spark, "prompts")
    prompts = load(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    prompts.select(F.concat(F.lit("  "), "line", F.lit("\t ")).alias("value")).write.text(path)
    return read_prompts(spark, path).groupBy("question").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "answers_text": _text,
    "answers_struct": _struct,
    "answers_filtered": _filtered,
    "answers_renamed": _renamed,
    "prompts_file": _prompts_file,
    "answers_json": _json,
    "request_params": _params,
    "chat_messages": _messages,
    "replicate": _replicate,
    "run_status_counts": _status_counts,
    "run_sweep": _sweep,
    "run_resumed": _resumed,
}

_OK = "length(text) % 7 <> 0"
_CONTENT = f"CASE WHEN {_OK} THEN 'none:' || md5(text) END"
_STATUS = f"CASE WHEN {_OK} THEN 'ok' ELSE 'error' END"

ORACLE = {
    "answers_text": f"SELECT doc_id, lang, {_CONTENT} AS answer FROM documents",
    "answers_struct": f"""SELECT doc_id, {_CONTENT} AS content, CASE WHEN {_OK} THEN 2 ELSE 0 END AS completion_tokens,
  CAST(CASE WHEN {_OK} THEN length(text) ELSE 0 END AS INT) AS prompt_tokens,
  CAST(CASE WHEN {_OK} THEN length(text) + 2 ELSE 0 END AS INT) AS total_tokens,
  CASE WHEN NOT {_OK} THEN 'refused ' || CAST(length(text) AS VARCHAR) END AS error_string, {_STATUS} AS status FROM documents""",
    "answers_filtered": f"""SELECT doc_id, {_CONTENT} AS content, CAST(length(text) + 2 AS INT) AS total_tokens FROM documents WHERE {_OK}""",
    "prompts_file": """SELECT trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS question, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""",
    "answers_renamed": f"""SELECT {_STATUS} AS status, count(*) FILTER ({_OK}) AS outputs, count(*) FILTER (NOT ({_OK})) AS errors
FROM documents GROUP BY ALL""",
    "answers_json": f"""SELECT doc_id, {_CONTENT} AS content, CAST(CASE WHEN {_OK} THEN length(text) + 2 ELSE 0 END AS INT) AS total_tokens,
  CASE WHEN NOT {_OK} THEN 'refused ' || CAST(length(text) AS VARCHAR) END AS error_string, 7 AS fields FROM documents""",
    "request_params": f"""SELECT doc_id, coalesce(wanted, 'small') AS model, CAST(0 AS DOUBLE) AS temperature, 1024 AS max_tokens,
  CASE WHEN {_OK} THEN coalesce(wanted, 'small') || ':' || md5(text) END AS answer
FROM (SELECT *, CASE WHEN lang = 'fr' THEN 'large' END AS wanted FROM documents)""",
    "chat_messages": f"""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue,
  CAST(CASE WHEN length(arg_max(text, turn)) % 7 <> 0 THEN count(*) ELSE 0 END AS INT) AS completion_tokens,
  CASE WHEN length(arg_max(text, turn)) % 7 <> 0 THEN 'ok' ELSE 'error' END AS status FROM conversations GROUP BY conv_id""",
    "replicate": """SELECT item_id, 6000 // (SELECT count(*) FROM benchmark) AS copies, CAST(length(trim(text)) AS INT) AS chars FROM benchmark""",
    "run_status_counts": f"""SELECT label AS test_label, {_STATUS} AS status, count(*) AS count
FROM documents, (VALUES ('first'), ('second')) AS l(label) GROUP BY ALL""",
    "run_resumed": f"""SELECT doc_id, 2 * count(*) AS answers, 2 * count(*) AS row_keys, count(DISTINCT {_CONTENT}) AS contents,
  min({_CONTENT}) AS content FROM documents GROUP BY ALL""",
    "run_sweep": f"""SELECT CAST(n AS INT) AS parallelism, 'sweep parallelism=' || CAST(n AS VARCHAR) AS test_label, {_STATUS} AS status,
  count(*) AS count FROM documents, (VALUES (2), (4), (8)) AS l(n) GROUP BY ALL""",
}
