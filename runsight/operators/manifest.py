"""Which files made up each version of a table, and how much they take."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsight.operators.skew import join_salted
from runsight.sources.commit_log import read_actions
from runsight.sources.staging import stage

TABLE = ("table_name", "table_location")
DEFAULT_RETENTION = "interval 7 days"
BROADCAST_VERSIONS = 500_000
"""Most table versions that are sent to every executor, by default."""
VERSIONS_PER_BLOCK = 10_000
"""Versions of a table that one task sums up."""


def _versions(actions: DataFrame, now: Column, default_retention: str) -> DataFrame:
    """One row per table version: its time, and whether it is retained.

    Retained are the versions since the cut, and the one that was current at the cut.
    """
    committed = F.max("commit_ts")
    if "modified_ts" in actions.columns:
        committed = F.coalesce(committed, F.max("modified_ts"))
    versions = actions.groupBy(*TABLE, "version").agg(
        committed.alias("version_timestamp"),
        F.max(F.when(F.col("action") == "metadata", F.col("retention"))).alias("_retention"),
        F.max(F.when(F.col("action") == "metadata", 1).otherwise(0)).alias("_has_metadata"),
    )
    metadata = F.when(F.col("_has_metadata") == 1, F.col("version"))
    retentions = versions.groupBy(*TABLE).agg(F.max_by("_retention", metadata).alias("_retention"))
    keep = F.coalesce(F.expr("try_cast(_retention AS INTERVAL)"), F.expr(f"CAST('{default_retention}' AS INTERVAL)"))
    cuts = retentions.select(*TABLE, (now - keep).alias("_cut"))
    timed = versions.drop("_retention", "_has_metadata").join(cuts, list(TABLE))
    bounds = timed.groupBy(*TABLE).agg(
        F.max("version").alias("_newest"),
        F.max(F.when(F.col("version_timestamp") <= F.col("_cut"), F.col("version"))).alias("_at_cut"),
    )
    retained = (F.col("version_timestamp") >= F.col("_cut")) | (F.col("version") == F.col("_at_cut"))
    return timed.join(bounds, list(TABLE)).select(
        *TABLE,
        "version",
        "version_timestamp",
        "_newest",
        F.when(retained, 1).otherwise(0).alias("in_retention_period"),
    )


def _lifetimes(actions: DataFrame) -> DataFrame:
    """From which version, and up to which, each file was live. A file added again has several lifetimes.

    A version holds at most one net action per file, so a file's history is no longer than its table's.
    """
    is_add = F.col("action") == "add"
    net = (
        actions.filter(F.col("action").isin("add", "remove"))
        # Serves the aggregation and the window below: one shuffle for both.
        .repartition(*TABLE, "file_name")
        .groupBy(*TABLE, "file_name", "version")
        .agg(
            F.max(F.when(is_add, 1).otherwise(0)).alias("_added"),
            F.max(F.when(is_add, F.col("file_size"))).alias("file_size"),
        )
    )
    history = Window.partitionBy(*TABLE, "file_name").orderBy("version")
    whole = history.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        net.select(
            "*",
            F.lead("version").over(history).alias("_until"),
            F.last("_added").over(whole).alias("latest_version"),
        )
        .filter(F.col("_added") == 1)
        .drop("_added")
    )


def _moment(now: datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _join_versions(rows: DataFrame, versions: DataFrame, broadcast_versions: int) -> DataFrame:
    """Rows with what is known of their version. The versions are counted, so that none but a short list is broadcast.

    Where they are many, the rows of each are dealt to several tasks, since one version may hold most of the files.
    """
    if versions.limit(broadcast_versions + 1).count() <= broadcast_versions:
        return rows.join(F.broadcast(versions), [*TABLE, "version"])
    names = [*TABLE, "version"]
    renamed = versions.withColumnsRenamed({name: f"_of_{name}" for name in names})
    same = reduce(Column.__and__, [rows[name] == renamed[f"_of_{name}"] for name in names])
    return join_salted(rows, renamed, same, hint="merge").drop(*[f"_of_{name}" for name in names])


def file_history(
    actions: DataFrame,
    now: datetime | Column | None = None,
    only_in_retention: bool = True,
    default_retention: str = DEFAULT_RETENTION,
    broadcast_versions: int = BROADCAST_VERSIONS,
) -> DataFrame:
    """One row per table version and live file, from action rows. Reads them twice: pass a stored table.

    Version numbers are whole, so a lifetime lists its versions itself and meets them by equality: no range join. Up to
    `broadcast_versions` versions are broadcast after they were counted.
    """
    versions = stage(_versions(actions, _moment(now), default_retention), "versions")
    if only_in_retention:
        versions = versions.filter(F.col("in_retention_period") == 1)
    spans = versions.groupBy(*TABLE).agg(
        F.min("version").alias("_lowest"), F.max("_newest").alias("_newest")
    )
    lived = (
        _lifetimes(actions)
        .join(spans, list(TABLE))
        .withColumn("_from", F.greatest("version", "_lowest"))
        .withColumn("_to", F.coalesce(F.col("_until") - 1, F.col("_newest")))
        .filter(F.col("_from") <= F.col("_to"))
        .select(*TABLE, "file_name", "file_size", "latest_version", F.explode(F.sequence("_from", "_to")).alias("version"))
    )
    return _join_versions(lived, versions.drop("_newest"), broadcast_versions).select(
        "table_name",
        "table_location",
        F.col("version").alias("table_version_number"),
        "version_timestamp",
        "file_name",
        "file_size",
        "in_retention_period",
        "latest_version",
    )


def write_manifest(
    spark: SparkSession,
    tables: Mapping[str, str],
    output_table: str,
    now: datetime | Column | None = None,
    only_in_retention: bool = True,
    path: str | None = None,
    unusable: str = "error",
) -> DataFrame:
    """File history of `tables` (name to location) as a new table; it must not exist.

    `unusable` is what to do about tables without a usable commit log, see `read_actions`.
    """
    if spark.catalog.tableExists(output_table):
        raise ValueError(f"table {output_table} exists")
    actions = stage(read_actions(spark, tables, unusable), "actions")
    writer = file_history(actions, now, only_in_retention).write.mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(output_table)
    return spark.table(output_table)


def size_report(manifest: DataFrame) -> DataFrame:
    """Files and bytes per table, for the latest version, the retained versions and all; largest retained first.

    Tables without retained files are left out. A file belongs to the latest version if it is in that version with this
    size; a name that came back with another size counts once there.
    """
    files = manifest.groupBy("table_name", "file_name", "file_size").agg(
        F.max("table_version_number").alias("_last"), F.max("in_retention_period").alias("_retained")
    )
    # One row per version that was some file's last is left, so the manifest is read once and the window is short.
    ends = files.filter("table_name IS NOT NULL").groupBy("table_name", "_last", "_retained").agg(F.count(F.lit(1)).alias("_files"), F.sum("file_size").alias("_bytes"))
    newest = F.max("_last").over(Window.partitionBy("table_name"))
    return _size_rows(ends.withColumn("_latest", (F.col("_last") == newest).cast("int")))


def size_report_of_actions(
    actions: DataFrame,
    now: datetime | Column | None = None,
    default_retention: str = DEFAULT_RETENTION,
    broadcast_versions: int = BROADCAST_VERSIONS,
) -> DataFrame:
    """The size report straight from action rows, without a row per version and file. Reads them twice: pass a stored table.

    A lifetime is in the latest version if it has no end, and in a retained one if the first retained version since its
    start comes before its end.
    """
    versions = stage(_versions(actions, _moment(now), default_retention), "versions")
    onwards = Window.partitionBy(*TABLE).orderBy(F.col("version").desc())
    kept = F.min(F.when(F.col("in_retention_period") == 1, F.col("version"))).over(onwards)
    lives = _join_versions(_lifetimes(actions), versions.select(*TABLE, "version", kept.alias("_kept")), broadcast_versions)
    retained = F.coalesce(F.col("_kept") < F.col("_until"), F.col("_kept").isNotNull())
    files = lives.groupBy("table_name", "file_name", "file_size").agg(
        F.max(F.col("_until").isNull().cast("int")).alias("_latest"), F.max(retained.cast("int")).alias("_retained")
    )
    return _size_rows(files.withColumns({"_files": F.lit(1), "_bytes": F.col("file_size")}))


def version_totals(
    actions: DataFrame, now: datetime | Column | None = None, default_retention: str = DEFAULT_RETENTION, block: int = VERSIONS_PER_BLOCK
) -> DataFrame:
    """Per table version: files, bytes, and files that the latest version still holds. Reads the actions twice: pass a stored table.

    A lifetime adds its file at its start and takes it away at its end. These changes are summed per version where they are read, and
    versions run through prefix sums in blocks, so the cost is two rows per lifetime, however many versions it spans.
    Versions without files have zeros; files of unknown size count as 0 bytes.
    """
    versions = stage(_versions(actions, _moment(now), default_retention), "versions")
    measures = {"files": F.lit(1), "bytes": F.coalesce("file_size", F.lit(0)), "still_live": F.col("latest_version")}

    def change(at: str, sign: int) -> Column:
        return F.struct(F.col(at).alias("version"), *[(value * sign).cast("bigint").alias(name) for name, value in measures.items()])

    changes = _lifetimes(actions).select(*TABLE, F.inline(F.array(change("version", 1), change("_until", -1)))).filter("version IS NOT NULL")
    changes = changes.groupBy(*TABLE, "version").agg(*[F.sum(name).alias(name) for name in measures])
    steps = versions.join(changes, [*TABLE, "version"], "left").select(
        *versions.columns, *[F.coalesce(name, F.lit(0)).alias(name) for name in measures], F.floor(F.col("version") / F.lit(block)).alias("_block")
    )
    steps = stage(steps, "version_changes")
    blocks = Window.partitionBy(*TABLE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy(*TABLE, "_block").agg(*[F.sum(name).alias(f"_{name}") for name in measures])
    before = sums.select(*TABLE, "_block", *[F.coalesce(F.sum(f"_{name}").over(blocks), F.lit(0)).alias(f"_{name}") for name in measures])
    inside = Window.partitionBy(*TABLE, "_block").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.join(before, [*TABLE, "_block"]).select(
        *TABLE,
        F.col("version").alias("table_version_number"),
        "version_timestamp",
        "in_retention_period",
        *[(F.sum(name).over(inside) + F.col(f"_{name}")).alias(name) for name in measures],
    )


def _size_rows(files: DataFrame) -> DataFrame:
    """The report of rows that stand for `_files` files of `_bytes` bytes in all."""
    kinds = {"latest": F.col("_latest") == 1, "in_retention": F.col("_retained") == 1, "all": F.lit(True)}
    totals = files.groupBy("table_name").agg(
        *[F.coalesce(F.sum(F.when(test, F.col("_files"))), F.lit(0)).alias(f"_n_{kind}") for kind, test in kinds.items()],
        *[F.sum(F.when(test, F.col("_bytes"))).alias(f"_b_{kind}") for kind, test in kinds.items()],
    )
    # One row per table is left here.
    by_size = Window.orderBy(F.col("_b_in_retention").desc(), F.col("table_name"))
    ranked = totals.filter(F.col("_n_in_retention") > 0).withColumn("table_rank", F.row_number().over(by_size))
    rows = [
        F.struct(
            F.lit(kind).alias("type"),
            F.col(f"_n_{kind}").alias("num_files"),
            F.col(f"_b_{kind}").alias("total_file_size"),
        )
        for kind in kinds
    ]
    return (
        ranked.select("table_name", "table_rank", F.inline(F.array(*rows)))
        .filter(F.col("num_files") > 0)
        .select("type", "table_name", "num_files", "total_file_size", "table_rank")
        .orderBy(F.col("table_rank").asc(), F.col("type").desc())
    )
