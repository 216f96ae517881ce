from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from runsight.operators.manifest import file_history, size_report, size_report_of_actions, version_totals, write_manifest
from runsight.sources import read_actions, select_tables
from runsight.sources.staging import stage

DAY = 86_400_000
NOW = datetime.datetime(2024, 1, 31)
NOW_MS = int(NOW.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def commit(root, version, days_ago, *actions):
    log = root / "_delta_log"
    log.mkdir(parents=True, exist_ok=True)
    lines = [{"commitInfo": {"timestamp": NOW_MS - days_ago * DAY, "operation": "WRITE"}}, *actions]
    (log / f"{version:020d}.json").write_text("\n".join(map(json.dumps, lines)) + "\n")


def add(path, size):
    return {"add": {"path": path, "size": size, "partitionValues": {}, "dataChange": True}}


def remove(path):
    return {"remove": {"path": path, "deletionTimestamp": 1, "dataChange": True}}


def metadata(**configuration):
    return {"metaData": {"id": "x", "configuration": configuration}}


@pytest.fixture()
def lake(tmp_path):
    """Table a has its own retention; b has the default and no commit since; both are read in one job."""
    a, b = tmp_path / "a", tmp_path / "b"
    commit(a, 0, 30, metadata(**{"delta.deletedFileRetentionDuration": "interval 2 days"}), add("f1", 10), add("f2", 20))
    commit(a, 1, 20, remove("f1"), add("f3", 30))
    commit(a, 2, 1, remove("f3"), add("f1", 11))
    commit(a, 3, 0, remove("f2"), {"protocol": {"minReaderVersion": 1}})
    commit(b, 0, 60, metadata(), add("g1", 100))
    commit(b, 1, 50, add("g2", 200), remove("g1"))
    return {"db.a": str(a), "db.b": str(b)}


def rows(df):
    columns = ("table_name", "table_version_number", "file_name", "file_size", "in_retention_period", "latest_version")
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_all_versions(spark, lake):
    found = rows(file_history(read_actions(spark, lake), NOW, only_in_retention=False))
    assert found == [
        ("db.a", 0, "f1", 10, 0, 1),
        ("db.a", 0, "f2", 20, 0, 0),
        ("db.a", 1, "f2", 20, 1, 0),
        ("db.a", 1, "f3", 30, 1, 0),
        ("db.a", 2, "f1", 11, 1, 1),
        ("db.a", 2, "f2", 20, 1, 0),
        ("db.a", 3, "f1", 11, 1, 1),
        ("db.b", 0, "g1", 100, 0, 0),
        ("db.b", 1, "g2", 200, 1, 1),
    ]


def test_only_retained_versions(spark, lake):
    actions = read_actions(spark, lake)
    retained = file_history(actions, NOW)
    assert rows(retained) == [r for r in rows(file_history(actions, NOW, False)) if r[4] == 1]
    stamp = retained.filter("table_name = 'db.b'").first()["version_timestamp"]
    assert stamp == NOW - datetime.timedelta(days=50)


def test_retention_of_the_newest_metadata_counts(spark, lake, tmp_path):
    commit(tmp_path / "a", 4, 0, metadata(**{"delta.deletedFileRetentionDuration": "interval 40 days"}))
    assert {r[1] for r in rows(file_history(read_actions(spark, lake), NOW)) if r[0] == "db.a"} == {0, 1, 2, 3, 4}


def test_replaced_in_one_version_stays_live(spark, tmp_path):
    commit(tmp_path / "t", 0, 3, add("f", 1))
    commit(tmp_path / "t", 1, 2, remove("f"), add("f", 2))
    found = rows(file_history(read_actions(spark, {"t": str(tmp_path / "t")}), NOW, False))
    assert found == [("t", 0, "f", 1, 1, 1), ("t", 1, "f", 2, 1, 1)]


def test_checkpoint_stands_for_cleaned_commits(spark, tmp_path):
    root = tmp_path / "t"
    log = root / "_delta_log"
    log.mkdir(parents=True)
    for version, files in ((2, ["old"]), (4, ["a", "b"])):
        state = spark.createDataFrame(
            [((name, 5), None) for name in files] + [(None, ({"delta.deletedFileRetentionDuration": "interval 1 days"},))],
            "add struct<path: string, size: bigint>, metaData struct<configuration: map<string, string>>",
        )
        state.coalesce(1).write.parquet(str(tmp_path / f"out{version}"))
        (part,) = (tmp_path / f"out{version}").glob("*.parquet")
        (log / f"{version:020d}.checkpoint.parquet").write_bytes(part.read_bytes())
    commit(root, 4, 9, add("b", 5))
    commit(root, 5, 5, remove("a"))
    commit(root, 6, 0, add("c", 7))
    found = rows(file_history(read_actions(spark, {"t": str(root)}), NOW, False))
    assert [r[:3] for r in found] == [("t", 4, "a"), ("t", 4, "b"), ("t", 5, "b"), ("t", 6, "b"), ("t", 6, "c")]
    assert {r[1] for r in found if r[4] == 1} == {5, 6}


def test_sizes(spark, lake):
    report = [tuple(r) for r in size_report(file_history(read_actions(spark, lake), NOW, False)).collect()]
    assert report == [
        ("latest", "db.b", 1, 200, 1),
        ("in_retention", "db.b", 1, 200, 1),
        ("all", "db.b", 2, 300, 1),
        ("latest", "db.a", 1, 11, 2),
        ("in_retention", "db.a", 3, 61, 2),
        ("all", "db.a", 4, 71, 2),
    ]


def test_table_without_retained_files_is_left_out(spark, lake):
    manifest = file_history(read_actions(spark, lake), NOW, False)
    manifest = manifest.filter("table_name = 'db.a' OR in_retention_period = 0")
    assert {r["table_name"] for r in size_report(manifest).collect()} == {"db.a"}


def test_output_table_must_be_new(spark, lake):
    found = write_manifest(spark, lake, "manifest_out", NOW)
    assert found.count() == 6
    with pytest.raises(ValueError, match="exists"):
        write_manifest(spark, lake, "manifest_out", NOW)


def test_select_tables(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS picked")
    spark.range(1).write.mode("overwrite").saveAsTable("picked.t1")
    assert list(select_tables(spark, schemas=["picked"])) == ["picked.t1"]
    assert select_tables(spark, table_names=["picked.t1"])["picked.t1"].endswith("t1")
    for wrong in ({}, {"schemas": ["picked"], "table_names": ["picked.t1"]}, {"table_names": ["t1"]}):
        with pytest.raises(ValueError):
            select_tables(spark, **wrong)


STATE = "add struct<path: string, size: bigint>, metaData struct<configuration: map<string, string>>, sidecar struct<path: string>"


def checkpoint(spark, target, rows, schema=STATE):
    """One Parquet file of checkpoint rows under the given name."""
    out = target.parent.parent.parent / f"out-{target.name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(out))
    (part,) = out.glob("*.parquet")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(part.read_bytes())


def files_by_version(spark, tables, **options):
    return sorted(r[:3] for r in rows(file_history(read_actions(spark, tables, **options), NOW, False)))


def added(*names):
    return [((name, 5), None, None) for name in names]


def test_locations_with_encoded_signs(spark, tmp_path):
    for name in ("my table", "a%20b", "ü[1]"):
        commit(tmp_path / name, 0, 1, add(name, 1))
    tables = {f"t{n}": str(tmp_path / name) for n, name in enumerate(("my table", "a%20b", "ü[1]"))}
    tables["uri"] = (tmp_path / "my table").as_uri()
    found = files_by_version(spark, {**tables, "slash": str(tmp_path / "my table") + "/"})
    assert [(name, file) for name, _, file in found] == [("slash", "my table"), ("t0", "my table"), ("t1", "a%20b"), ("t2", "ü[1]"), ("uri", "my table")]


def test_sidecar_checkpoints(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    uuid = "80a083e8-7026-4e79-81be-64bd76c43a11"
    checkpoint(spark, log / f"{10:020d}.checkpoint.{uuid}.parquet", [(None, None, ("side-a.parquet",)), (None, None, ("side-b.parquet",)), *added("c")])
    checkpoint(spark, log / "_sidecars" / "side-a.parquet", added("a"))
    checkpoint(spark, log / "_sidecars" / "side-b.parquet", added("b"))
    commit(tmp_path / "t", 11, 0, remove("a"), add("d", 5))
    assert files_by_version(spark, {"t": str(tmp_path / "t")}) == [("t", 10, "a"), ("t", 10, "b"), ("t", 10, "c"), ("t", 11, "b"), ("t", 11, "c"), ("t", 11, "d")]


def test_json_checkpoints(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    lines = [{"sidecar": {"path": "s.parquet"}}, {"add": {"path": "a", "size": 5}}, {"checkpointMetadata": {"version": 4}}]
    (log / f"{4:020d}.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json").write_text("\n".join(map(json.dumps, lines)))
    checkpoint(spark, log / "_sidecars" / "s.parquet", added("b"))
    commit(tmp_path / "t", 5, 0, add("c", 5))
    assert [r for r in files_by_version(spark, {"t": str(tmp_path / "t")}) if r[1] == 5] == [("t", 5, "a"), ("t", 5, "b"), ("t", 5, "c")]


def test_checkpoints_in_parts_count_only_if_complete(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    for version, parts in ((3, (1, 2)), (4, (1,))):
        for part in parts:
            checkpoint(spark, log / f"{version:020d}.checkpoint.{part:010d}.{2:010d}.parquet", added(f"v{version}p{part}"))
    commit(tmp_path / "t", 4, 1, add("x", 5))
    found = files_by_version(spark, {"t": str(tmp_path / "t")})
    assert [r[2] for r in found if r[1] == 4] == ["v3p1", "v3p2", "x"]


def test_unusable_tables_are_named(spark, lake, tmp_path):
    commit(tmp_path / "gap", 7, 0, add("x", 1))
    checkpoint(spark, tmp_path / "gap" / "_delta_log" / f"{5:020d}.checkpoint.parquet", added("y"))
    (tmp_path / "empty" / "_delta_log").mkdir(parents=True)
    spark.range(1).write.parquet(str(tmp_path / "plain"))
    odd = {"gap": str(tmp_path / "gap"), "empty": str(tmp_path / "empty"), "plain": str(tmp_path / "plain"), "gone": str(tmp_path / "gone")}
    with pytest.raises(ValueError) as error:
        read_actions(spark, {**lake, **odd})
    assert all(name in str(error.value) for name in odd) and "db.a" not in str(error.value)
    with pytest.warns(UserWarning, match="plain"):
        found = files_by_version(spark, {**lake, **odd}, unusable="skip")
    assert found == files_by_version(spark, lake)
    with pytest.raises(ValueError):
        read_actions(spark, odd, unusable="skip")


def test_sizes_from_actions_are_those_of_the_table(spark, lake):
    actions = read_actions(spark, lake)
    want = size_report(file_history(actions, NOW, False)).collect()
    for broadcast_versions in (0, 100):
        assert size_report_of_actions(actions, NOW, broadcast_versions=broadcast_versions).collect() == want
        assert rows(file_history(actions, NOW, broadcast_versions=broadcast_versions)) == rows(file_history(actions, NOW))


@pytest.mark.parametrize("seed, block", [(0, 1), (1, 3), (2, 10_000)])
def test_totals_per_version_are_those_of_the_history(spark, seed, block):
    dice = random.Random(seed)
    rows = []
    for table in ("t1", "t2"):
        for version in range(30):
            if dice.random() < 0.2:
                continue
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=version)
            rows.append((table, f"/{table}", version, "commit", None, None, at, None))
            for name in dice.sample(range(12), dice.randint(0, 4)):
                kind = dice.choice(["add", "add", "remove"])
                rows.append((table, f"/{table}", version, kind, f"f{name}", dice.choice([None, 5, 70]) if kind == "add" else None, None, None))
    actions = spark.createDataFrame(rows, "table_name string, table_location string, version long, action string, file_name string, file_size long, commit_ts timestamp, retention string")
    now = datetime.datetime(2024, 1, 20)
    history = file_history(actions, now, only_in_retention=False)
    keys = ["table_name", "table_location", "table_version_number", "version_timestamp", "in_retention_period"]
    expected = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.sum("latest_version").alias("still_live"))
    found = version_totals(actions, now, block=block)
    assert sorted(map(tuple, found.filter("files > 0").collect())) == sorted(map(tuple, expected.collect()))
    assert found.count() == actions.select("table_name", "version").distinct().count()
    assert version_totals(actions.limit(0), now).collect() == []


def test_totals_cost_the_same_rows_however_many_versions_a_file_lives(spark, capsys):
    commits = [("t", "/t", v, "commit", None, None, datetime.datetime(2024, 1, 1), None) for v in range(500)]
    adds = [("t", "/t", 0, "add", f"f{i}", 1, None, None) for i in range(20)]
    actions = spark.createDataFrame(commits + adds, "table_name string, table_location string, version long, action string, file_name string, file_size long, commit_ts timestamp, retention string")
    found = version_totals(actions, datetime.datetime(2024, 1, 2))
    assert {r["files"] for r in found.collect()} == {20} and found.count() == 500
    found.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan


def test_the_size_report_reads_the_manifest_once(spark):
    columns = "table_name string, file_name string, file_size bigint, table_version_number bigint, in_retention_period int"
    rows = [("t", "a", 5, 1, 0), ("t", "a", 5, 2, 1), ("t", "b", 7, 1, 0), ("t", "c", None, 2, 1), ("u", "a", 3, 4, 1), (None, "z", 9, 9, 1)]
    manifest = stage(spark.createDataFrame(rows, columns), "manifest")
    report = size_report(manifest)
    assert {tuple(r) for r in report.collect()} == {
        ("latest", "t", 2, 5, 1), ("in_retention", "t", 2, 5, 1), ("all", "t", 3, 12, 1),
        ("latest", "u", 1, 3, 2), ("in_retention", "u", 1, 3, 2), ("all", "u", 1, 3, 2),
    }
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
