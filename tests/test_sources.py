from __future__ import annotations

import re

import pytest

from runsight.sources import append_labelled, materialize, read_json_dir, run_name, stage
from runsight.sources.staging import scratch_root


def test_materialize_replaces_and_analyzes(spark):
    materialize(spark.range(3), "mat")
    found = materialize(spark.range(5), "mat", analyze=True, stats_columns=["id"])
    assert found.count() == 5
    details = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE TABLE EXTENDED mat").collect()}
    assert "5 rows" in details["Statistics"]
    stats = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE TABLE EXTENDED mat id").collect()}
    assert stats["max"] == "4"


def test_append_and_names(spark):
    append_labelled(spark.range(2), "labelled", "a")
    append_labelled(spark.range(3), "labelled", "b")
    assert {r["test_label"]: r["count"] for r in spark.table("labelled").groupBy("test_label").count().collect()} == {"a": 2, "b": 3}
    assert run_name("t", "7") == "t_7"
    assert re.fullmatch(r"t_\d{8}_\d{6}_\d{6}", run_name("t"))


def test_stage_cuts_the_lineage(spark):
    staged = stage(spark.range(10).selectExpr("id", "id % 2 AS part"), "s", partition_by=["part"])
    assert staged.count() == 10 and staged.schema["part"].dataType.simpleString() == "bigint"
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Range" not in plan


def test_json_dir_skips_bad_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\nnot json\n{"x": 2}\n')
    assert sorted(r["x"] for r in read_json_dir(spark, str(tmp_path), "x bigint").collect()) == [1, 2]


def test_scratch_root(spark, monkeypatch):
    root = scratch_root(spark)
    assert root == (spark.conf.get("spark.checkpoint.dir", None) or root).rstrip("/")


def test_scratch_root_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(cluster)


def test_tables_stored_by_their_key_are_joined_without_a_shuffle(spark, capsys):
    one = materialize(spark.range(1000).selectExpr("id AS a", "id % 7 AS x"), "by_key_one", bucket_by=["a"], buckets=4)
    other = materialize(spark.range(3000).selectExpr("id % 1500 AS b", "id AS y"), "by_key_other", bucket_by=["b"], buckets=4, analyze=True)
    joined = one.join(other.hint("merge"), one["a"] == other["b"]).groupBy("a").agg({"y": "sum"})
    assert joined.count() == 1000 and joined.filter("a = 3").first()[1] == 3 + 1503
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again = materialize(spark.range(5).selectExpr("id AS a", "0 AS x"), "by_key_one", bucket_by=["a"], buckets=4)
    assert again.count() == 5
