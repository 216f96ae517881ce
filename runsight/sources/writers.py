from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_name(prefix: str, run_id: str | None = None) -> str:
    """`prefix` with the run's id, by default the UTC time."""
    return f"{prefix}_{run_id or datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S_%f')}"


def materialize(
    df: DataFrame,
    table: str,
    *,
    analyze: bool = False,
    stats_columns: Sequence[str] = (),
    path: str | None = None,
    bucket_by: Sequence[str] = (),
    buckets: int = 200,
) -> DataFrame:
    """Create or replace `table` from `df`, optionally with table and column statistics.

    With `bucket_by`, the rows are dealt by these columns into `buckets` files, each sorted by them. Tables dealt by the same
    columns into as many buckets are joined and grouped by these without a shuffle. The rows are dealt out before they are
    written, so that there is one file per bucket and not one per bucket and task.
    """
    spark = df.sparkSession
    if bucket_by:
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    if analyze:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    if stats_columns:
        names = ", ".join(f"`{name}`" for name in stats_columns)
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {names}")
    return spark.table(table)


def append_labelled(df: DataFrame, table: str, label: str, label_col: str = "test_label", path: str | None = None) -> None:
    """Append one run's rows to a shared table, marked by `label`."""
    writer = df.withColumn(label_col, F.lit(label)).write.mode("append")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
