"""A per-row service called from Spark tasks, with errors kept as rows.

A client is built once per partition by a factory that Spark ships to the workers, so it needs no pickling itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runsight.sources.staging import recorded_staging, remove_staged, stage
from runsight.sources.writers import append_labelled, run_name

ANSWER_SCHEMA = (
    "content string, completion_tokens int, prompt_tokens int, total_tokens int, "
    "latency float, error_string string, status string"
)
TIMED_FIELDS = "started_ms bigint, finished_ms bigint"
DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant"
BYTES_PER_TASK = 256 * 2**20
"""Stored input, as Parquet, that one task of a labelled run answers before its next one starts."""
ROW_GROUP = 8 * 2**20
COPIES_PER_BLOCK = 10_000
"""Copies of one row that are numbered by one task."""
PARAM_TYPES = {"model": "string", "temperature": "double", "max_tokens": "int"}


class Completion(NamedTuple):
    content: str | None
    completion_tokens: int
    prompt_tokens: int


class Client(Protocol):
    def complete(self, messages: list[dict[str, str]], params: dict[str, Any]) -> Completion:
        """Answer a conversation. May raise."""


ClientFactory = Callable[[], Client]


def with_request_params(
    df: DataFrame,
    defaults: Mapping[str, Any],
    columns: Mapping[str, str | Column] | None = None,
    out: str = "request_params",
) -> DataFrame:
    """Add the request parameters of each row: its own value where there is one, else the default."""
    columns = columns or {}
    fields = []
    for name, kind in PARAM_TYPES.items():
        value = F.lit(defaults.get(name)).cast(kind)
        if name in columns:
            own = columns[name]
            value = F.coalesce((F.col(own) if isinstance(own, str) else own).cast(kind), value)
        fields.append(value.alias(name))
    return df.withColumn(out, F.struct(*fields))


def assemble_messages(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    out: str = "messages",
) -> DataFrame:
    """One row per conversation with its messages in turn order. A conversation is one request, hence one array."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role).alias("role"), F.col(content).alias("content"))))
    plain = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return df.groupBy(conversation).agg(plain.alias(out))


def _call(client: Client, messages: list[dict[str, str]] | None, params: dict[str, Any]) -> tuple:
    started = time.time()
    try:
        if not messages:
            raise ValueError("no prompt and no messages")
        done = client.complete(messages, params)
        total = done.prompt_tokens + done.completion_tokens
        answer = (done.content, done.completion_tokens, done.prompt_tokens, total, time.time() - started, None, "ok")
    except Exception as error:  # one bad row must not fail its batch
        answer = (None, 0, 0, 0, 0.0, str(error), "error")
    return (*answer, int(started * 1000), int(time.time() * 1000))


def _answer_column(
    request: Column, client_factory: ClientFactory, system_prompt: str | None, schema: StructType | str
) -> Column:
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = struct.fieldNames()
    if len(names) not in (7, 9):
        raise ValueError("an answer has 7 fields, or 9 with its times")

    def messages_of(row: dict[str, Any]) -> list[dict[str, str]] | None:
        if "prompt" not in row:
            given = row["messages"]
            return None if given is None else [{"role": m["role"], "content": m["content"]} for m in given]
        if not row["prompt"]:
            return None
        system = [{"role": "system", "content": system_prompt}] if system_prompt else []
        return [*system, {"role": "user", "content": row["prompt"]}]

    # Not deterministic, so that the optimizer never copies the call, for instance below a filter on the answer.
    @F.pandas_udf(struct)
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            answers = []
            for row in batch.to_dict("records"):
                given = row.get("params") or {}
                params = {name: None if pd.isna(value) else value for name, value in dict(given).items()}
                answers.append(_call(client, messages_of(row), params)[: len(names)])
            yield pd.DataFrame.from_records(answers, columns=names)

    return ask.asNondeterministic()(request)


def answer(
    df: DataFrame,
    client_factory: ClientFactory,
    *,
    prompt: str | None = None,
    messages: str | None = None,
    params: str | None = None,
    system_prompt: str | None = DEFAULT_SYSTEM_PROMPT,
    schema: StructType | str = ANSWER_SCHEMA,
    timed: bool = False,
    out: str = "answer",
) -> DataFrame:
    """Add the answer struct of each row.

    The service is called once per row that is read, also if answers are filtered, taken apart or joined. Give either `prompt`, a text that is sent after the system prompt, or `messages`, an array of (role, content)
    that is sent as it is. `schema` may rename the seven fields. `timed` adds when each call began and ended.
    """
    if (prompt is None) == (messages is None):
        raise ValueError("give one of prompt and messages")
    fields = [F.col(prompt).alias("prompt") if prompt else F.col(messages).alias("messages")]
    fields += [F.col(params).alias("params")] if params else []
    if timed:
        struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = StructType([*struct.fields, *StructType.fromDDL(TIMED_FIELDS).fields])
    return df.withColumn(out, _answer_column(F.struct(*fields), client_factory, system_prompt, schema))


def answer_text(df: DataFrame, client_factory: ClientFactory, *, out: str = "answer", **options) -> DataFrame:
    """Add only the answer's text; NULL on error."""
    answered = answer(df, client_factory, out="_answer", **options)
    return answered.withColumn(out, F.when(F.col("_answer.status") == "ok", F.col("_answer.content"))).drop("_answer")


def as_json(column: Column | str) -> Column:
    """An answer struct as JSON text, NULL fields included."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def answer_json(df: DataFrame, client_factory: ClientFactory, *, out: str = "answer", **options) -> DataFrame:
    answered = answer(df, client_factory, out="_answer", **options)
    return answered.withColumn(out, as_json(F.col("_answer"))).drop("_answer")


def replicate(df: DataFrame, target_rows: int, rows: int | None = None) -> DataFrame:
    """Repeat all rows as often as whole copies fit into `target_rows`. No join and no shuffle."""
    copies = target_rows // (df.count() if rows is None else rows)
    if copies < 1:
        return df.limit(0)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")


def status_counts(runs: DataFrame, label: str | None = None) -> DataFrame:
    """Rows per run label and answer status."""
    if label is not None:
        runs = runs.filter(F.col("test_label") == label)
    return runs.groupBy("test_label", F.col("answer.status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def labelled_run(
    df: DataFrame,
    parallelism: int,
    client_factory: ClientFactory,
    results_table: str,
    *,
    label: str | None = None,
    path: str | None = None,
    prompt: str = "question",
    task_bytes: int = BYTES_PER_TASK,
    **options,
) -> dict[str, Any]:
    """Answer all rows with `parallelism` tasks at a time, append them under a label, and report time and status counts.

    The label must be new to the table. Each row gets a `row_id` before it is answered, unique within the run: a row that
    a repeated task attempt wrote twice can be recognised by it.

    So that few tasks can answer many rows, the rows are stored first and answered in rounds of `parallelism` tasks with about
    `task_bytes` of stored input each, one append per round. If a round fails, the rounds before it stay under the label.
    """
    label = label or f"{run_name('run')} parallelism={parallelism}"
    _check_new(df.sparkSession, results_table, label)
    with recorded_staging() as folders:
        try:
            return _labelled_run(stored_rows(df), parallelism, client_factory, results_table, label, path, prompt, task_bytes, options)
        finally:
            # The result is in the table; nothing reads these any more.
            remove_staged(df.sparkSession, folders)


def _check_new(spark: SparkSession, results_table: str, label: str) -> None:
    if spark.catalog.tableExists(results_table) and spark.table(results_table).filter(F.col("test_label") == label).limit(1).count():
        raise ValueError(f"{results_table} holds a run labelled {label!r}")


@dataclass(frozen=True)
class StoredRows:
    """Rows stored as files, and the size of each file."""

    frame: DataFrame
    sizes: dict[str, int]


def stored_rows(df: DataFrame) -> StoredRows:
    """Store the rows, so that runs can read them in parts. The frame's own partitions write them: nothing is shuffled."""
    rows = stage(df, "run_rows", row_group=ROW_GROUP)
    system = rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = rows.sparkSession._jsc.hadoopConfiguration()
    paths = {uri: system(rows.sparkSession._jvm.java.net.URI(uri)) for uri in rows.inputFiles()}
    return StoredRows(rows, {path.toString(): path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths.values()})


def _rounds(rows: StoredRows, most: int) -> list[list[str]]:
    """Files of each round: up to `most` bytes, or one file that is larger."""
    rounds, size = [[]], 0
    for path, own in sorted(rows.sizes.items()):
        if rounds[-1] and size + own > most:
            rounds.append([])
            size = 0
        rounds[-1].append(path)
        size += own
    return rounds


def _dealt(rows: DataFrame, parallelism: int) -> DataFrame:
    """The rows in `parallelism` partitions. Stored parts that are enough for these are put together; fewer are shuffled."""
    return rows.coalesce(parallelism) if rows.rdd.getNumPartitions() >= 2 * parallelism else rows.repartition(parallelism)


def _labelled_run(
    rows: StoredRows,
    parallelism: int,
    client_factory: ClientFactory,
    results_table: str,
    label: str,
    path: str | None,
    prompt: str,
    task_bytes: int,
    options: Mapping[str, Any],
) -> dict[str, Any]:
    spark = rows.frame.sparkSession
    _check_new(spark, results_table, label)
    started = time.time()
    for number, files in enumerate(_rounds(rows, parallelism * task_bytes)):
        part = spark.read.schema(rows.frame.schema).parquet(*files) if files else rows.frame
        # Ids of a task are within 2^33, so rounds don't share any.
        row_id = F.monotonically_increasing_id() + F.lit(number * parallelism << 33)
        answered = answer(_dealt(part, parallelism).withColumn("row_id", row_id), client_factory, prompt=prompt, timed=True, **options)
        append_labelled(answered, results_table, label, path=path)
    run_time = time.time() - started
    counts = status_counts(spark.table(results_table), label)
    return {"label": label, "run_time": run_time, "status_counts": counts}


def _blocks_of_copies(df: DataFrame, columns: Sequence[str] | None, block: int) -> DataFrame:
    """Each distinct row as (_row, _hash, _first, _last): once for each `block` of its copies, which have the numbers _first to _last."""
    named = [F.col(f"`{name}`") for name in (columns or df.columns)]
    hashes = F.concat_ws("-", F.hex(F.xxhash64(F.lit(0), *named)), F.hex(F.xxhash64(F.lit(1), *named)))
    whole = F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_row")
    # Only hashes are shuffled to see whether any row has more copies than one task may number.
    often = df.select(hashes.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).limit(1).count()
    counted = df.select(hashes.alias("_hash"), whole).groupBy("_hash").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    if not often:
        return counted.select("_row", "_hash", F.lit(0).cast("bigint").alias("_first"), (F.col("_n") - 1).alias("_last"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.lit(block)))))
    first, last = F.col("_block") * block, F.least(F.col("_n"), (F.col("_block") + 1) * block) - 1
    # Blocks of one row come from one task, but need not stay there.
    return blocks.repartition("_hash", "_block").select("_row", "_hash", first.alias("_first"), last.alias("_last"))


def _copies(blocks: DataFrame) -> DataFrame:
    return _keys(blocks, "_row").select("_row.*", "row_key")


def _keys(blocks: DataFrame, *columns: str) -> DataFrame:
    each = blocks.select(*columns, "_hash", F.explode(F.sequence("_first", "_last")).alias("_copy"))
    return each.select(*columns, F.concat_ws("-", "_hash", F.col("_copy").cast("string")).alias("row_key"))


def keyed_rows(df: DataFrame, columns: Sequence[str] | None = None, block: int = COPIES_PER_BLOCK) -> DataFrame:
    """The rows with a `row_key` that follows from what they hold: the hash of `columns`, by default all, and the number of the copy.

    Equal rows are numbered without being collected: they are counted, and the count is dealt out again in blocks. So whatever order
    or partitions the rows come in, a table has the same keys. With `columns`, rows that are equal in these must be equal in the others.
    """
    return _copies(_blocks_of_copies(df, columns, block))


def resumable_run(
    df: DataFrame,
    client_factory: ClientFactory,
    results_table: str,
    label: str,
    *,
    slices: int = 10,
    columns: Sequence[str] | None = None,
    stored: Sequence[str] | None = None,
    path: str | None = None,
    parallelism: int | None = None,
    prompt: str = "question",
    **options,
) -> DataFrame:
    """Answer all rows that `results_table` doesn't hold under `label` yet, and return all rows of that label.

    Rows are known by `keyed_rows`. They are answered in `slices`, each appended by one job: if that fails, nothing of the slice is
    stored, and a later call with the same rows and label asks for that slice and the later ones only. Copies of one row are in one
    slice. Answers that are errors are answers. `stored` names the columns of `df` that are kept beside key and answer, by default
    all. Two calls for one label must not run at a time.
    """
    spark = df.sparkSession
    with recorded_staging() as folders:
        try:
            slice_of = lambda hashes: F.pmod(F.xxhash64(hashes), F.lit(slices)).cast("int")
            blocks = _blocks_of_copies(df, columns, COPIES_PER_BLOCK).withColumn("_slice", slice_of(F.col("_hash")))
            blocks = stage(blocks, "keyed_rows", partition_by=["_slice"])
            kept = [*(df.columns if stored is None else stored), "row_key", "answer"]
            for number in range(slices):
                part = blocks.filter(F.col("_slice") == number)
                waiting = _copies(part)
                if spark.catalog.tableExists(results_table):
                    done = spark.table(results_table).filter(F.col("test_label") == label).select("row_key")
                    done = done.filter(slice_of(F.substring_index("row_key", "-", 2)) == number)
                    # Keys alone say what is missing: mostly all of a slice, or nothing.
                    keys = stage(_keys(part).join(done.withColumn("_done", F.lit(True)), "row_key", "left").select("row_key", F.col("_done").isNull().alias("_missing")), "row_keys")
                    some, every = keys.agg(F.coalesce(F.bool_or("_missing"), F.lit(False)), F.coalesce(F.bool_and("_missing"), F.lit(False))).first()
                    if not some:
                        continue
                    if not every:
                        waiting = waiting.join(keys.filter("_missing").select("row_key"), "row_key", "left_semi")
                waiting = waiting.repartition(parallelism) if parallelism else waiting
                answered = answer(waiting, client_factory, prompt=prompt, timed=True, **options)
                append_labelled(answered.select(*[f"`{name}`" for name in kept]), results_table, label, path=path)
        finally:
            # The result is in the table; nothing reads these any more.
            remove_staged(spark, folders)
    return spark.table(results_table).filter(F.col("test_label") == label)


def sweep(
    df: DataFrame,
    parallelisms: Sequence[int],
    client_factory: ClientFactory,
    results_table: str,
    *,
    label: str = "sweep",
    path: str | None = None,
    prompt: str = "question",
    task_bytes: int = BYTES_PER_TASK,
    **options,
) -> DataFrame:
    """One labelled run per parallelism, one after the other: each row is a run's time and count of one status.

    Labels hold the time, so sweeps can be repeated into one table. The rows are stored once for all runs, see `labelled_run`.
    """
    spark: SparkSession = df.sparkSession
    rows = []
    with recorded_staging() as folders:
        try:
            stored = stored_rows(df)
            for parallelism in parallelisms:
                name = f"{run_name(label)} parallelism={parallelism}"
                run = _labelled_run(stored, parallelism, client_factory, results_table, name, path, prompt, task_bytes, options)
                rows += [
                    (parallelism, name, run["run_time"], row["status"], row["count"]) for row in run["status_counts"].collect()
                ]
        finally:
            remove_staged(spark, folders)
    return spark.createDataFrame(
        rows, "parallelism int, test_label string, run_time_s double, status string, count bigint"
    )


def peak_concurrency(
    runs: DataFrame, start_ms: str, end_ms: str, keys: Sequence[str] = ("test_label",), slot_ms: int = 60_000
) -> DataFrame:
    """Most calls open at one time, per key. A call is open from its start until before its end.

    Changes are summed per millisecond first, so a time slot holds at most `slot_ms` rows. The running sum goes over
    the totals of the slots, then within each slot.
    """
    keys = list(keys)
    changes = (
        runs.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.col(start_ms).alias("_at"), F.lit(1).alias("_change")),
                    F.struct(F.col(end_ms).alias("_at"), F.lit(-1).alias("_change")),
                )
            ),
        )
        .groupBy(*keys, F.floor(F.col("_at") / F.lit(slot_ms)).alias("_slot"), "_at")
        .agg(F.sum("_change").alias("_change"))
    )
    within = Window.partitionBy(*keys, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = (
        changes.withColumn("_open", F.sum("_change").over(within))
        .groupBy(*keys, "_slot")
        .agg(F.max("_open").alias("_peak"), F.sum("_change").alias("_total"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return (
        slots.withColumn("_peak", open_before + F.col("_peak")).groupBy(*keys).agg(F.max("_peak").alias("peak_concurrency"))
    )
