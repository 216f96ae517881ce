"""Queries of the general operators on the given tables: joins, statistics, outliers, file history, sinks."""

from __future__ import annotations

import datetime
import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.log_fixture import EVENT_TYPES
from checks.tables import load, stored
from runsight.functions import canonical_name
from runsight.operators.asof import attach_last_window
from runsight.operators.distinct_counts import common_bitmaps, distinct_counts, id_bitmaps, merge_bitmaps
from runsight.operators.group_stats import group_stats
from runsight.operators.inference import peak_concurrency
from runsight.operators.manifest import file_history, size_report, size_report_of_actions, version_totals
from runsight.operators.outliers import Thresholds, add_group_outliers, classify
from runsight.operators.percentile_sketches import merge_sketches, percentiles_by_sketch, sketch_values
from runsight.operators.windows import attach_window
from runsight.sources import append_labelled, materialize, parse_actions, read_actions, read_json_dir
from runsight.sources.staging import scratch_path, stage

DAY_MS = 86_400_000
K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
THRESHOLDS = Thresholds(low=1, high=2)


def _rounded(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(prefixes)})


def _canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", canonical_name("p_name").alias("name"), canonical_name(F.concat("p_type", F.lit(" (p)"))).alias("type"))


def _attach_window(spark: SparkSession, sf_dir: str, slot: int | None = None) -> DataFrame:
    """Lines shipped within 30 days of their order, with a day of grace."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("shipped")
    )
    placed = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", placed.alias("placed"), (placed + 30 * DAY_MS).alias("due"), "o_orderpriority"
    )
    return attach_window(
        lines,
        orders,
        on={"l_orderkey": "o_orderkey"},
        start="shipped",
        end="shipped",
        window_start="placed",
        window_end="due",
        grace=DAY_MS,
        slot=slot,
        drop=(),
    )


def _stats_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = group_stats(
        load(spark, sf_dir, "events"), ["user_id"], {"value": "value", "k": K}, distinct_of="event_type", distinct_as="types"
    )
    return _rounded(stats, "avg_", "median_", "p95_")


def _stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", spread=True)
    stats = group_stats(
        documents, ["source", "lang"], {"chars": "n_chars", "words": "size(split(text, ' '))"}, prefix="doc_", rows_as="docs"
    )
    return _rounded(stats, "doc_")


def _stats_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way that large groups take: exact percentiles over range partitions."""
    stats = group_stats(
        load(spark, sf_dir, "events"), ["event_type"], {"value": "value", "k": K}, hot_rows=1
    )
    return _rounded(stats, "avg_", "median_", "p95_")


def _stats_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way of large groups: their percentiles narrowed down by sketches."""
    stats = group_stats(load(spark, sf_dir, "events"), ["event_type"], {"value": "value", "k": K}, hot_rows=1, large_by="sketch")
    return _rounded(stats, "avg_", "median_", "p95_")


def _merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all rows and of each type, from sketches that are stored per type and day. Few values at once, so that brackets are refined."""
    events, values = load(spark, sf_dir, "events"), {"value": "value", "k": K}
    daily = stage(sketch_values(events, ["event_type", F.to_date("ts").alias("day")], values), "daily_sketches")

    def of(*keys: str) -> DataFrame:
        found = percentiles_by_sketch(events, keys, values, (0.5, 0.95), sketches=merge_sketches(daily, keys, list(values)), at_once=100)
        kind = F.col("event_type") if keys else F.lit("all")
        columns = [F.round(F.col(name)[i], 6).alias(f"{label}_{name}") for name in values for i, label in enumerate(("median", "p95"))]
        return found.select(kind.alias("event_type"), *columns)

    return of("event_type").unionByName(of())


def _distinct_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users in two tables whose users overlap: of each, of both together, and common to both."""
    events = load(spark, sf_dir, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    one, other = (stage(id_bitmaps(events.filter(test), ["event_type"], "user_id"), "user_bitmaps") for test in (early, ~early))
    tables = {"early": one, "late": other, "together": merge_bitmaps([one, other], ["event_type"]), "common": common_bitmaps([one, other], ["event_type"])}
    parts = [distinct_counts(bitmaps, ["event_type"], "users").withColumn("of", F.lit(name)) for name, bitmaps in tables.items()]
    return reduce(DataFrame.unionByName, parts).filter("users > 0")


def _last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event between two purchases of its user, with the first of these: the windows follow one another without overlap."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    events = load(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"), "event_type")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "at").agg(F.max("event_id").alias("purchase_id"))
    until = F.lead("at").over(Window.partitionBy("user_id").orderBy("at")) - 1
    windows = bought.select(F.col("user_id").alias("buyer"), F.col("at").alias("bought_at"), until.alias("until"), "purchase_id").filter("until IS NOT NULL")
    bounds = {"start": "at", "end": "at", "window_start": "bought_at", "window_end": "until"}
    return attach_last_window(stage(events, "events"), stage(windows, "purchases"), on={"user_id": "buyer"}, ranges=32, drop=(), **bounds).drop("buyer")


def _stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, each stored by order, joined and summed up without a shuffle."""
    names = {}
    for table, key, columns in (("orders", "o_orderkey", ["o_orderpriority"]), ("lineitem", "l_orderkey", ["l_quantity", "l_linenumber"])):
        names[table] = f"{table}_{uuid.uuid4().hex}"
        materialize(load(spark, sf_dir, table).select(key, *columns), names[table], path=scratch_path(spark, table), bucket_by=[key], buckets=16)
    joined = spark.table(names["orders"]).join(spark.table(names["lineitem"]).hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"))


def _event_outliers(spark: SparkSession, sf_dir: str, key: str = "user_id", **options) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("k", F.expr(K))
    rows = add_group_outliers(
        events.select("event_id", "user_id", "event_type", "value", "k"),
        [key],
        "value",
        {"props_score": {"k": "k", "id_digit": "event_id % 10"}},
        thresholds=THRESHOLDS,
        **options,
    )
    rows = classify(rows, outlier="gt_p95_1")
    return _rounded(rows, "group_avg_", "group_median_", "group_p95_").drop("event_type" if key != "event_type" else "user_id")


def _outlier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexplained outliers per score of the rows."""
    rows = _event_outliers(spark, sf_dir)
    return rows.groupBy("overall_score").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("outlier_class") == "unexplained", 1)).alias("unexplained"),
        F.sum("gt_median_10").alias("above_median"),
    )


TABLES = {f"shop.orders_p{i}": f"/lake/orders_p{i}" for i in range(1, 6)}
NOW = datetime.datetime(2003, 12, 1)


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit log derived from `orders`: one table per priority, one version per month, one file per order.

    Files of finished orders are removed later, and some of those come back.
    """
    orders = load(spark, sf_dir, "orders", spread=True)
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    base = orders.select(
        F.concat(F.lit("/lake/orders_p"), F.substring("o_orderpriority", 1, 1)).alias("location"),
        month.cast("bigint").alias("added"),
        (month + 1 + F.col("o_orderkey") % 24).cast("bigint").alias("removed"),
        F.concat(F.lit("part-"), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("path"),
        F.round("o_totalprice").cast("bigint").alias("size"),
        (F.col("o_orderstatus") == "F").alias("gone"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0)).alias("back"),
    )

    def action(version, kind, **fields):
        body = F.struct(*[F.col(column).alias(name) if isinstance(column, str) else column.alias(name) for name, column in fields.items()])
        return F.struct(version.alias("version"), F.to_json(F.struct(body.alias(kind))).alias("value"))

    actions = base.select(
        "location",
        F.explode(
            F.filter(
                F.array(
                    action(F.col("added"), "add", path="path", size="size"),
                    F.when(F.col("gone"), action(F.col("removed"), "remove", path="path")),
                    F.when(F.col("back"), action(F.col("removed") + 3, "add", path="path", size=F.col("size") + 1)),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("a"),
    ).select("location", "a.version", "a.value")
    day = F.make_date((F.lit(1995) + F.floor(F.col("version") / 12)).cast("int"), (F.col("version") % 12 + 1).cast("int"), F.lit(1))
    commits = actions.select("location", "version").distinct().select(
        "location",
        "version",
        F.to_json(F.struct(F.struct(F.unix_millis(day.cast("timestamp")).alias("timestamp")).alias("commitInfo"))).alias("value"),
    )
    keep = F.when(F.col("location").endswith("1"), "interval 90 days").when(F.col("location").endswith("2"), "interval 400 days")
    metadata = actions.groupBy("location").agg(F.min("version").alias("version")).select(
        "location",
        "version",
        F.to_json(
            F.struct(F.struct(F.create_map(F.lit("delta.deletedFileRetentionDuration"), keep).alias("configuration")).alias("metaData"))
        ).alias("value"),
    )
    lines = actions.unionByName(commits).unionByName(metadata)
    path = F.concat(F.lit("file:"), F.col("location"), F.lit("/_delta_log/"), F.lpad(F.col("version").cast("string"), 20, "0"), F.lit(".json"))
    return lines.select(path.alias("path"), "value")


def _history(spark: SparkSession, sf_dir: str, only_in_retention: bool) -> DataFrame:
    return file_history(_actions(spark, sf_dir), NOW, only_in_retention)


def _manifest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir, True)
    return rows.withColumn("version_timestamp", F.date_format("version_timestamp", "yyyy-MM-dd"))


FIRST_COMMIT = 40
"""From here on the third table has commits; a checkpoint at the first of them stands for the others."""


def _write_logs(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The same commit logs as files in the shared folder: one location holds a space, one table begins with a checkpoint."""
    root = scratch_path(spark, "commit logs")
    lines = stored(spark, sf_dir, "commit_lines", lambda: stage(commit_lines(spark, sf_dir), "commit_lines"))
    actions = parse_actions(lines, {name: place for name, place in TABLES.items() if name.endswith("3")})
    first = actions.filter(F.col("version") >= FIRST_COMMIT).agg(F.min("version")).first()[0]
    state = (
        actions.filter((F.col("version") <= first) & F.col("action").isin("add", "remove"))
        .groupBy("file_name")
        .agg(F.max_by(F.struct("action", "file_size"), "version").alias("last"))
        .filter("last.action = 'add'")
        .select(F.struct(F.col("file_name").alias("path"), F.col("last.file_size").alias("size")).alias("add"))
    )
    state.coalesce(1).write.parquet(f"{root}/state")
    table = F.regexp_extract("path", r"orders_p([0-9])", 1)
    version = F.regexp_extract("path", r"([0-9]{20})\.json$", 1)
    files = lines.select(table.alias("table"), version.alias("version"), "value")
    files = files.filter((F.col("table") != "3") | (F.col("version").cast("int") >= FIRST_COMMIT))
    # Logs begin at version 0, also where no order is that early.
    begin = [(name[-1], "0" * 20, '{"commitInfo":{"timestamp":0}}') for name in TABLES if not name.endswith("3")]
    files = files.union(spark.createDataFrame(begin, files.schema))
    files.repartition("table", "version").write.partitionBy("table", "version").text(f"{root}/parts")
    # Only names are changed from here: the writer's to those of a commit log.
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    locations = {name: f"{root}/lake/orders {name[-2:]}" if name.endswith("2") else f"{root}/lake/{name[-2:]}" for name in TABLES}
    for name, location in locations.items():
        system.mkdirs(path(f"{location}/_delta_log"))
        for folder in system.listStatus(path(f"{root}/parts/table={name[-1]}")):
            for part in system.globStatus(path(folder.getPath(), "part-*")):
                system.rename(part.getPath(), path(f"{location}/_delta_log/{folder.getPath().getName().removeprefix('version=')}.json"))
    for part in system.globStatus(path(f"{root}/state/part-*")):
        system.rename(part.getPath(), path(f"{locations['shop.orders_p3']}/_delta_log/{first:020d}.checkpoint.parquet"))
    return locations


def _manifest_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file history of commit logs on disk: commits, and a checkpoint where commits are gone."""
    actions = stage(read_actions(spark, _write_logs(spark, sf_dir)), "actions")
    rows = file_history(actions, NOW, True)
    return rows.drop("table_location").withColumn("version_timestamp", F.date_format("version_timestamp", "yyyy-MM-dd"))


def _manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _history(spark, sf_dir, False)
        .groupBy("table_name", "table_version_number", "in_retention_period")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("latest_version").alias("still_live"))
    )


def _version_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `manifest_versions` has, from the starts and ends of lifetimes."""
    return version_totals(_actions(spark, sf_dir), NOW, block=16).drop("table_location", "version_timestamp").filter("files > 0")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(spark, sf_dir, "commit_lines", lambda: stage(commit_lines(spark, sf_dir), "commit_lines"))
    return stage(parse_actions(lines, TABLES), "actions")


def _manifest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_report_of_actions(_actions(spark, sf_dir), NOW)


def _manifest_sizes_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_report(stage(_history(spark, sf_dir, False), "manifest"))


def _peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    calls = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("test_label"), start.alias("start_ms"), (start + F.round(F.col("value") * 1000).cast("bigint") * 60).alias("end_ms")
    )
    return peak_concurrency(calls, "start_ms", "end_ms")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "events")
        .groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    )


def _sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored with statistics, appended in one labelled run per event type, read back."""
    name = f"daily_{uuid.uuid4().hex}"
    daily = materialize(
        _daily(spark, sf_dir), name, analyze=True, stats_columns=["day"], path=scratch_path(spark, "daily")
    )
    runs, path = f"runs_{uuid.uuid4().hex}", scratch_path(spark, "runs")
    for event_type in EVENT_TYPES:
        append_labelled(daily.filter(F.col("event_type") == event_type), runs, f"run {event_type}", path=path)
    return spark.table(runs)


def _json_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    _daily(spark, sf_dir).write.json(path)
    return read_json_dir(spark, path, "event_type string, day string, n bigint, last_id bigint")


QUERIES = {
    "canonical_names": _canonical_names,
    "attach_window": _attach_window,
    "attach_window_slots": partial(_attach_window, slot=7 * DAY_MS),
    "group_stats_users": _stats_by_user,
    "group_stats_documents": _stats_by_source,
    "group_stats_large_groups": _stats_of_large_groups,
    "group_stats_sketches": _stats_by_sketch,
    "percentiles_merged_sketches": _merged_sketches,
    "distinct_bitmaps": _distinct_bitmaps,
    "attach_last_window": _last_purchase,
    "stored_join": _stored_join,
    "flag_outliers": _event_outliers,
    "flag_outliers_large_groups": partial(_event_outliers, key="event_type", hot_rows=1, split_rows=1),
    "outlier_score": _outlier_score,
    "manifest_history": _manifest_history,
    "manifest_from_files": _manifest_from_files,
    "manifest_versions": _manifest_versions,
    "manifest_version_totals": _version_totals,
    "manifest_sizes": _manifest_sizes,
    "manifest_sizes_from_table": _manifest_sizes_from_table,
    "peak_concurrency": _peak_concurrency,
    "sink_roundtrip": _sink_roundtrip,
    "json_dir": _json_dir,
}

_K_SQL = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _stats_sql(metrics: dict[str, str], prefix: str = "") -> str:
    return ", ".join(
        f"round(avg({c}), 6) AS {prefix}avg_{n}, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS {prefix}median_{n}, "
        f"round(CAST(quantile_cont({c}, 0.95) AS DOUBLE), 6) AS {prefix}p95_{n}"
        for n, c in metrics.items()
    )


def _event_outliers_sql(key: str) -> str:
    other = "event_type" if key != "event_type" else "user_id"
    return f"""WITH e AS (SELECT event_id, user_id, event_type, value, {_K_SQL} AS k, event_id % 10 AS digit FROM events),
s AS (
  SELECT {key}, count(*) AS group_num_rows, {_stats_sql({"value": "value", "k": "k", "id_digit": "digit"}, "group_")}
  FROM e GROUP BY ALL
),
q AS (
  SELECT {key}, median(value) AS mv, quantile_cont(value, 0.95) AS pv, quantile_cont(k, 0.95) AS pk, quantile_cont(digit, 0.95) AS pd
  FROM e GROUP BY ALL
),
f AS (
  SELECT e.*, CAST(value > pv AS INT) AS gt_p95_1, CAST(value > pv * 2 AS INT) AS gt_p95_2, CAST(value > mv * 10 AS INT) AS gt_median_10,
         CAST(k > pk AS INT) AS gt_p95_1_k, CAST(k > pk * 2 AS INT) AS gt_p95_2_k,
         CAST(digit > pd AS INT) AS gt_p95_1_id_digit, CAST(digit > pd * 2 AS INT) AS gt_p95_2_id_digit
  FROM e JOIN q USING ({key})
),
flagged AS (
  SELECT f.* EXCLUDE (digit, {other}), s.* EXCLUDE ({key}),
         gt_p95_1_k + gt_p95_2_k + gt_p95_1_id_digit + gt_p95_2_id_digit AS props_score
  FROM f JOIN s USING ({key})
),
classed AS (
  SELECT *, props_score AS overall_score,
         CASE WHEN gt_p95_1 > 0 THEN CASE WHEN props_score > 0 THEN 'explained' ELSE 'unexplained' END END AS outlier_class
  FROM flagged
)
"""


_WINDOW_SQL = f"""SELECT l_orderkey, l_linenumber, epoch_ms(l_shipdate) AS shipped, o_orderkey, epoch_ms(o_orderdate) AS placed,
  epoch_ms(o_orderdate) + {30 * DAY_MS} AS due, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate
  AND l_shipdate <= o_orderdate + INTERVAL 31 DAY"""

_MANIFEST_SQL = """WITH o AS (
  SELECT substr(o_orderpriority, 1, 1) AS p, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS v,
         o_orderkey AS id, 'part-' || CAST(o_orderkey AS VARCHAR) || '.parquet' AS file, CAST(round(o_totalprice) AS BIGINT) AS size,
         o_orderstatus = 'F' AS gone FROM orders
),
acts AS (
  SELECT p, v, 1 AS added, file, size FROM o
  UNION ALL SELECT p, v + 1 + id % 24, 0, file, NULL FROM o WHERE gone
  UNION ALL SELECT p, v + 1 + id % 24 + 3, 1, file, size + 1 FROM o WHERE gone AND id % 10 = 0
),
timed AS (
  SELECT *, TIMESTAMP '2003-12-01' - CASE p WHEN '1' THEN INTERVAL 90 DAY WHEN '2' THEN INTERVAL 400 DAY ELSE INTERVAL 7 DAY END AS cut
  FROM (SELECT DISTINCT p, v, make_timestamp(1995 + v // 12, v % 12 + 1, 1, 0, 0, 0) AS ts FROM acts)
),
versions AS (
  SELECT p, v, ts, CASE WHEN ts >= cut OR v = max(v) FILTER (ts <= cut) OVER (PARTITION BY p) THEN 1 ELSE 0 END AS kept FROM timed
),
lives AS (
  SELECT *, lead(v) OVER (PARTITION BY p, file ORDER BY v) AS until,
         last_value(added) OVER (PARTITION BY p, file ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest
  FROM acts
),
history AS (
  SELECT 'shop.orders_p' || l.p AS table_name, '/lake/orders_p' || l.p AS table_location, w.v AS table_version_number,
         strftime(ts, '%Y-%m-%d') AS version_timestamp, file AS file_name, size AS file_size, kept AS in_retention_period,
         latest AS latest_version
  FROM lives l JOIN versions w ON l.p = w.p AND w.v >= l.v AND (until IS NULL OR w.v < until) WHERE added = 1
)
"""

_DAILY_SQL = """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL"""

_SIZES_SQL = (
    _MANIFEST_SQL
    + """, files AS (
  SELECT table_name, file_name, file_size, max(CAST(table_version_number = newest AS INT)) AS latest, max(in_retention_period) AS kept
  FROM (SELECT *, max(table_version_number) OVER (PARTITION BY table_name) AS newest FROM history) GROUP BY ALL
),
kinds AS (
  SELECT 'latest' AS type, table_name, count(*) AS num_files, CAST(sum(file_size) AS BIGINT) AS total_file_size FROM files WHERE latest = 1 GROUP BY ALL
  UNION ALL SELECT 'in_retention', table_name, count(*), CAST(sum(file_size) AS BIGINT) FROM files WHERE kept = 1 GROUP BY ALL
  UNION ALL SELECT 'all', table_name, count(*), CAST(sum(file_size) AS BIGINT) FROM files GROUP BY ALL
),
ranks AS (
  SELECT table_name, CAST(row_number() OVER (ORDER BY total_file_size DESC, table_name) AS INT) AS table_rank FROM kinds WHERE type = 'in_retention'
)
SELECT * FROM kinds JOIN ranks USING (table_name)"""
)

_VERSIONS_SQL = (
    _MANIFEST_SQL
    + """SELECT table_name, table_version_number, in_retention_period, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
  CAST(sum(latest_version) AS BIGINT) AS still_live FROM history GROUP BY ALL"""
)

_QUANTILES_SQL = ", ".join(
    f"round(CAST(quantile_cont({c}, {p}) AS DOUBLE), 6) AS {label}_{c}" for c in ("value", "k") for label, p in (("median", 0.5), ("p95", 0.95))
)

ORACLE = {
    "canonical_names": """SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9_]+', '_', 'g')) AS name,
  lower(regexp_replace(p_type || ' (p)', '[^a-zA-Z0-9_]+', '_', 'g')) AS type FROM part""",
    "attach_window": _WINDOW_SQL,
    "attach_window_slots": _WINDOW_SQL,
    "group_stats_users": f"""SELECT user_id, count(*) AS num_rows, count(DISTINCT event_type) AS types,
  {_stats_sql({"value": "value", "k": "k"})} FROM (SELECT *, {_K_SQL} AS k FROM events) GROUP BY ALL""",
    "group_stats_documents": f"""SELECT source, lang, count(*) AS docs,
  {_stats_sql({"chars": "n_chars", "words": "len(string_split(text, ' '))"}, "doc_")} FROM documents GROUP BY ALL""",
    "group_stats_large_groups": f"""SELECT event_type, count(*) AS num_rows,
  {_stats_sql({"value": "value", "k": "k"})} FROM (SELECT *, {_K_SQL} AS k FROM events) GROUP BY ALL""",
    "group_stats_sketches": f"""SELECT event_type, count(*) AS num_rows,
  {_stats_sql({"value": "value", "k": "k"})} FROM (SELECT *, {_K_SQL} AS k FROM events) GROUP BY ALL""",
    "percentiles_merged_sketches": f"""SELECT coalesce(event_type, 'all') AS event_type, {_QUANTILES_SQL}
  FROM (SELECT *, {_K_SQL} AS k FROM events) GROUP BY GROUPING SETS ((event_type), ())""",
    "distinct_bitmaps": """WITH e AS (SELECT event_type, user_id, ts < TIMESTAMP '2024-01-16' AS early FROM events),
u AS (SELECT event_type, user_id, bool_or(early) AS a, bool_or(NOT early) AS b FROM e GROUP BY ALL)
SELECT event_type, 'early' AS of, count(*) AS users FROM u WHERE a GROUP BY ALL UNION ALL
SELECT event_type, 'late', count(*) FROM u WHERE b GROUP BY ALL UNION ALL SELECT event_type, 'together', count(*) FROM u GROUP BY ALL
UNION ALL SELECT event_type, 'common', count(*) FROM u WHERE a AND b GROUP BY ALL""",
    "attach_last_window": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS "at", event_type FROM events),
p AS (SELECT user_id, "at" AS bought_at, max(event_id) AS purchase_id FROM e WHERE event_type = 'purchase' GROUP BY ALL),
w AS (SELECT *, lead(bought_at) OVER (PARTITION BY user_id ORDER BY bought_at) - 1 AS until FROM p)
SELECT e.*, bought_at, until, purchase_id FROM e JOIN w USING (user_id) WHERE "at" BETWEEN bought_at AND until""",
    "stored_join": """SELECT o_orderkey, o_orderpriority, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "flag_outliers": _event_outliers_sql("user_id") + "SELECT * FROM classed",
    "flag_outliers_large_groups": _event_outliers_sql("event_type") + "SELECT * FROM classed",
    "outlier_score": _event_outliers_sql("user_id")
    + """SELECT overall_score, count(*) AS n, count(*) FILTER (outlier_class = 'unexplained') AS unexplained,
  CAST(sum(gt_median_10) AS BIGINT) AS above_median FROM classed GROUP BY ALL""",
    "manifest_history": _MANIFEST_SQL + "SELECT * FROM history WHERE in_retention_period = 1",
    "manifest_from_files": _MANIFEST_SQL
    + f"""SELECT * EXCLUDE (table_location) FROM history WHERE in_retention_period = 1
  AND NOT (table_name = 'shop.orders_p3' AND table_version_number < {FIRST_COMMIT})""",
    "manifest_versions": _VERSIONS_SQL,
    "manifest_version_totals": _VERSIONS_SQL,
    "manifest_sizes": _SIZES_SQL,
    "manifest_sizes_from_table": _SIZES_SQL,
    "peak_concurrency": """WITH c AS (
  SELECT event_type, epoch_us(ts) // 1000 AS began, CAST(round(value * 1000) AS BIGINT) * 60 AS took FROM events
),
d AS (SELECT event_type, began AS t, 1 AS change FROM c UNION ALL SELECT event_type, began + took, -1 FROM c),
m AS (SELECT event_type, t, sum(change) AS change FROM d GROUP BY ALL),
r AS (SELECT event_type, sum(change) OVER (PARTITION BY event_type ORDER BY t) AS opened FROM m)
SELECT event_type AS test_label, CAST(max(opened) AS BIGINT) AS peak_concurrency FROM r GROUP BY ALL""",
    "sink_roundtrip": f"SELECT *, 'run ' || event_type AS test_label FROM ({_DAILY_SQL})",
    "json_dir": _DAILY_SQL,
}
