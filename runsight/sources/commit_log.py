"""Commit logs of tables: JSON commits and checkpoints of the open Delta format, as rows of actions.

Checkpoints may be single files, several parts, or named by a UUID as Parquet or JSON with the files listed in sidecars. Log files are
first listed by name; of the checkpoints, only those needed are read. All tables and versions are read in one job. Nothing checks
that the data files exist.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETENTION_PROPERTY = "delta.deletedFileRetentionDuration"
ACTION_COLUMNS = (
    "table_name",
    "table_location",
    "version",
    "commit_ts",
    "action",
    "file_name",
    "file_size",
    "retention",
)

_ADD = "add struct<path: string, size: bigint>"
_METADATA = "metaData struct<configuration: map<string, string>>"
_COMMIT = (
    f"{_ADD}, {_METADATA}, remove struct<path: string>, "
    "commitInfo struct<timestamp: bigint, inCommitTimestamp: bigint>"
)
_COMMIT_FILE = r"^\d{20}\.json$"
_CHECKPOINT_FILE = r"^(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10})|\.[0-9a-fA-F-]{36})?\.(parquet|json)$"
_STATE = f"{_ADD}, {_METADATA}, sidecar struct<path: string>"


def _plain(location: Column) -> Column:
    """A URI's path without scheme, authority and slashes at its ends."""
    return F.regexp_replace(location, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*|^/+|/+$", "")


def _log_folder(spark: SparkSession, location: str):
    """The commit log's folder as Hadoop's path and its file system, or None. The location may be a path or an encoded URI."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(location.rstrip("/") or "/")]
    if "%" in location:
        paths.append(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(location.rstrip("/"))))
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path, "_delta_log")
        if folder.getFileSystem(conf).exists(folder):
            return path, folder
    return None


def _encoded_path(spark: SparkSession, location: str) -> str:
    """The location's path as it stands in file URIs."""
    found = _log_folder(spark, location)
    path = found[0] if found else spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.toUri().getRawPath()


def _no_pattern(path: str) -> str:
    """The path for a reader that takes patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _file(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def _place(path: str) -> list[Column]:
    """Location of the table and version of the commit a log file belongs to."""
    return [
        F.substring_index(path, "/_delta_log/", 1).alias("_location"),
        F.substring(_file(path), 1, 20).try_cast("bigint").alias("version"),
    ]


def _named(df: DataFrame, tables: Mapping[str, str]) -> DataFrame:
    # One row per table the caller listed, so the broadcast is as small as that list.
    names = df.sparkSession.createDataFrame(list(tables.items()), "table_name string, table_location string")
    known = {name: _encoded_path(df.sparkSession, location) for name, location in tables.items()}
    paths = df.sparkSession.createDataFrame(list(known.items()), "_name string, _path string")
    names = names.join(F.broadcast(paths), F.col("table_name") == F.col("_name")).select("table_name", "table_location", _plain(F.col("_path")).alias("_known"))
    return df.join(F.broadcast(names), _plain(F.col("_location")) == F.col("_known")).drop("_known", "_location")


def parse_actions(lines: DataFrame, tables: Mapping[str, str], modified: str | None = None) -> DataFrame:
    """Action rows of commit lines, given as `path` and `value`.

    A version's time is that of its commit info; `modified` names a column with the file's time for logs without it.
    """
    record = F.from_json("value", _COMMIT)
    rows = (
        lines.filter(_file("path").rlike(_COMMIT_FILE))
        .select(
            *_place("path"),
            (F.col(modified) if modified else F.lit(None).cast("timestamp")).alias("_modified"),
            F.inline(F.array(record)),
        )
        .withColumn(
            "action",
            F.when(F.col("add").isNotNull(), "add")
            .when(F.col("remove").isNotNull(), "remove")
            .when(F.col("metaData").isNotNull(), "metadata")
            .when(F.col("commitInfo").isNotNull(), "commit"),
        )
    )
    committed = F.coalesce("commitInfo.inCommitTimestamp", "commitInfo.timestamp")
    named = _named(rows, tables)
    return named.select(
        "table_name",
        "table_location",
        "version",
        F.timestamp_millis(committed).alias("commit_ts"),
        F.coalesce("action", F.lit("other")).alias("action"),
        F.coalesce("add.path", "remove.path").alias("file_name"),
        F.col("add.size").alias("file_size"),
        F.element_at("metaData.configuration", RETENTION_PROPERTY).alias("retention"),
        F.col("_modified").alias("modified_ts"),
    )


def list_logs(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Per table with a commit log: its first commit, and the files of the newest complete checkpoint up to that commit.

    Only names are listed. Columns: table_name, table_location, first_commit, checkpoint_version, checkpoint_files.
    """
    folders = [_no_pattern(found[1].toString()) for location in tables.values() if (found := _log_folder(spark, location))]
    if not folders:
        return spark.createDataFrame([], "table_name string, table_location string, first_commit bigint, checkpoint_version bigint, checkpoint_files array<string>")
    files = spark.read.format("binaryFile").load(folders).select(F.col("_metadata.file_path").alias("path"))
    named = _named(files.select("path", *_place("path")), tables).withColumn("_file", _file("path"))
    first = named.groupBy("table_name", "table_location").agg(F.min(F.when(F.col("_file").rlike(_COMMIT_FILE), F.col("version"))).alias("first_commit"))
    part, parts = (F.nullif(F.regexp_extract("_file", _CHECKPOINT_FILE, n), F.lit("")).cast("int") for n in (2, 3))
    sets = (
        named.filter(F.col("_file").rlike(_CHECKPOINT_FILE))
        # A checkpoint in parts is one if all are there; any other file is one by itself.
        .withColumn("_set", F.when(part.isNotNull(), F.concat(F.lit("parts "), parts.cast("string"))).otherwise(F.col("_file")))
        .groupBy("table_name", "version", "_set")
        .agg(F.count_distinct("_file").alias("_found"), F.max(F.coalesce(parts, F.lit(1))).alias("_parts"), F.collect_set("path").alias("files"))
        .filter(F.col("_found") == F.col("_parts"))
    )
    usable = sets.join(first.select("table_name", "first_commit"), "table_name").filter(F.col("version") <= F.col("first_commit"))
    best = usable.groupBy("table_name").agg(F.max(F.struct("version", "_set", "files")).alias("_best"))
    return first.join(best, "table_name", "left").select(
        "table_name", "table_location", "first_commit", F.col("_best.version").alias("checkpoint_version"), F.col("_best.files").alias("checkpoint_files")
    )


def unusable_tables(tables: Mapping[str, str], logs: Iterable) -> dict[str, str]:
    """Why the state of tables can't be known, by name; `logs` are rows of `list_logs`."""
    known = {row["table_name"]: row for row in logs}
    reasons = {}
    for name in tables:
        row = known.get(name)
        if row is None:
            reasons[name] = "has no commit log"
        elif row["first_commit"] is None:
            reasons[name] = "has no commits"
        elif row["first_commit"] > 0 and (row["checkpoint_version"] is None or row["checkpoint_version"] < row["first_commit"] - 1):
            reasons[name] = f"has no complete checkpoint up to its first commit, version {row['first_commit']}"
    return reasons


def _state_actions(state: DataFrame, files: DataFrame) -> DataFrame:
    """Action rows of checkpoint rows, given with the `path` of their file; `files` has the table and version of each."""
    plain = state.filter(F.col("add").isNotNull() | F.col("metaData").isNotNull())
    # As many rows as there are checkpoint files.
    placed = plain.join(F.broadcast(files), _plain(F.col("path")) == F.col("_known"))
    return placed.select(
        "table_name",
        "table_location",
        "version",
        F.lit(None).cast("timestamp").alias("commit_ts"),
        F.when(F.col("add").isNotNull(), "add").otherwise("metadata").alias("action"),
        F.col("add.path").alias("file_name"),
        F.col("add.size").alias("file_size"),
        F.element_at("metaData.configuration", RETENTION_PROPERTY).alias("retention"),
        F.col("modified").alias("modified_ts"),
    )


def _uri_paths(spark: SparkSession, uris: Iterable[str]) -> list[str]:
    """Encoded file URIs as paths for a reader."""
    jvm = spark._jvm
    return [_no_pattern(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()) for uri in uris]


def _read_state(spark: SparkSession, uris: Sequence[str]) -> DataFrame | None:
    """Rows of checkpoint files of both formats: path, modified, add, metaData, sidecar."""
    found = None
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")]
    for kind in ("parquet", "json"):
        paths = _uri_paths(spark, [uri for uri in uris if uri.endswith(kind)])
        if paths and kind == "parquet":
            part = spark.read.schema(_STATE).parquet(*paths).select(*place, "add", "metaData", "sidecar")
        elif paths:
            part = spark.read.text(paths).select(*place, F.inline(F.array(F.from_json("value", _STATE))))
        else:
            continue
        found = part if found is None else found.unionByName(part)
    return found


def read_checkpoints(spark: SparkSession, tables: Mapping[str, str], logs: Sequence | None = None) -> DataFrame | None:
    """Action rows of the checkpoints that stand for commits which are gone, or None if there are none.

    `logs` are the rows of `list_logs`, if they are known already.
    """
    logs = list_logs(spark, tables).collect() if logs is None else logs
    needed = [row for row in logs if row["first_commit"] and row["checkpoint_files"]]
    if not needed:
        return None
    files = [(row["table_name"], row["table_location"], row["checkpoint_version"], uri) for row in needed for uri in row["checkpoint_files"]]
    state = _read_state(spark, [uri for *_, uri in files])
    listed = state.filter(F.col("sidecar").isNotNull()).select("path", "sidecar.path").toDF("path", "sidecar").collect()
    place = {_plain_uri(uri): row for *row, uri in files}
    sidecars = []
    for row in listed:
        own = row["sidecar"]
        uri = own if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", own) else f"{row['path'].rpartition('/')[0]}/_sidecars/{own}"
        sidecars.append((*place[_plain_uri(row["path"])], uri))
    if sidecars:
        more = _read_state(spark, [uri for *_, uri in sidecars])
        state = state.unionByName(more)
    where = spark.createDataFrame([tuple(x) for x in files + sidecars], "table_name string, table_location string, version bigint, _uri string")
    return _state_actions(state, where.select("table_name", "table_location", "version", _plain(F.col("_uri")).alias("_known")))


def _plain_uri(uri: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*|^/+|/+$", "", uri)


def read_actions(spark: SparkSession, tables: Mapping[str, str], unusable: str = "error") -> DataFrame:
    """Action rows of all `tables` (name to location).

    Where the first commits were cleaned away, the newest complete checkpoint up to the first commit that is left
    stands for them: its live files count as added in the checkpoint's version.

    Tables without a commit log, without commits, or with a gap before their first commit are an error that names
    them; with `unusable="skip"` they are left out, and a warning names them.
    """
    if unusable not in ("error", "skip"):
        raise ValueError("unusable is error or skip")
    logs = list_logs(spark, tables).collect()
    reasons = unusable_tables(tables, logs)
    if reasons:
        said = "; ".join(f"{name} {reason}" for name, reason in reasons.items())
        if unusable == "error" or len(reasons) == len(tables):
            raise ValueError(f"no file history: {said}")
        warnings.warn(f"left out: {said}", stacklevel=2)
        tables = {name: location for name, location in tables.items() if name not in reasons}
        logs = [row for row in logs if row["table_name"] in tables]
    folders = [_no_pattern(_log_folder(spark, location)[1].toString()) for location in tables.values()]
    lines = spark.read.option("pathGlobFilter", "*.json").text(folders).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "value",
    )
    commits = parse_actions(lines, tables, "modified")
    checkpoints = read_checkpoints(spark, tables, logs)
    return commits if checkpoints is None else commits.unionByName(checkpoints.select(*commits.columns))


def select_tables(
    spark: SparkSession, schemas: Sequence[str] = (), table_names: Sequence[str] = ()
) -> dict[str, str]:
    """Names and locations of the tables of some schemas, or of named tables; full names, and not both."""
    if bool(schemas) == bool(table_names):
        raise ValueError("give either schemas or table names")
    if not all("." in name for name in table_names):
        raise ValueError("table names must be full names")
    names = list(table_names) or [
        f"{schema}.{table.name}" for schema in schemas for table in spark.catalog.listTables(schema) if not table.isTemporary
    ]
    located = {}
    for name in names:
        detail = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()
        if detail is not None:
            located[name] = detail["data_type"]
    return located
