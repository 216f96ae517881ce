from __future__ import annotations

import json

from pyspark.sql import functions as F

from runsight.functions import canonical_text
from runsight.operators import metrics
from runsight.operators.metric_keys import ACCUMULABLE_KEYS, TASK_METRIC_KEYS


def record(task_metrics=None, items=None, **info):
    body = {"Event": "SparkListenerTaskEnd"}
    if task_metrics is not None:
        body["Task Metrics"] = task_metrics
    if items is not None:
        body["Task Info"] = {"Accumulables": items, **info}
    return json.dumps(body)


def records(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, logMessage string")


def flat(spark, *texts):
    rows = records(spark, *texts).select("i", metrics.flatten_int_json("logMessage").alias("j")).orderBy("i").collect()
    return [json.loads(row["j"]) for row in rows]


def latest(spark, text, keys=("rows out", "peak"), **options):
    row = records(spark, text).select(metrics.latest_by_id("logMessage", keys, **options).alias("j")).first()
    return json.loads(row["j"])


def test_only_integers_are_kept_and_nested_names_are_joined(spark):
    found = flat(
        spark,
        record(
            {
                "JVM GC Time": 5,
                "Half": 1.5,
                "Whole float": 2.0,
                "Text": "7",
                "Flag": True,
                "Nothing": None,
                "List": [1, 2],
                "Negative": -3,
                "Big": 9_007_199_254_740_993,
                "Shuffle Read Metrics": {"Remote (Bytes) Read": 8, "Push": {"Merged": 3, "Half": 0.5}},
            }
        ),
    )
    assert found == [
        {
            "jvm_gc_time": 5,
            "negative": -3,
            "big": 9_007_199_254_740_993,
            "shuffle_read_metrics__remote_bytes_read": 8,
            "shuffle_read_metrics__push__merged": 3,
        }
    ]


def test_missing_section_and_bad_json_give_nothing(spark):
    assert flat(spark, record(), "no json", "", record({})) == [{}, {}, {}, {}]


def test_depth_is_an_argument(spark):
    text = record({"A": {"B": {"C": {"D": 4}}}})
    deep = records(spark, text).select(metrics.flatten_int_json("logMessage", depth=4)).first()[0]
    assert json.loads(deep) == {"a__b__c__d": 4}
    assert flat(spark, text) == [{}]


def test_names_that_become_equal_keep_the_last(spark):
    df = metrics.with_metrics(records(spark, '{"Task Metrics": {"Result Size": 1, "result-size": 2}}'), ["result_size"])
    assert df.first()["task_metrics"]["result_size"] == 2


def test_absent_keys_are_null(spark):
    row = metrics.with_metrics(records(spark, record({"JVM GC Time": 1}))).first()["task_metrics"]
    assert row["jvm_gc_time"] == 1
    assert len(row) == len(TASK_METRIC_KEYS)
    assert sum(value is not None for value in row) == 1


def test_highest_id_wins_in_any_order(spark):
    items = [
        {"ID": 9, "Name": "Rows (out", "Value": "12"},
        {"ID": 3, "Name": "rows out", "Value": "5"},
        {"ID": 4, "Name": "other", "Value": "1"},
    ]
    assert latest(spark, record(items=items)) == {"rows_out_id": 9, "rows_out": 12}


def test_value_that_is_no_integer_keeps_the_id_and_the_earlier_value(spark):
    items = [{"ID": 9, "Name": "rows out", "Value": "12.5"}, {"ID": 3, "Name": "rows out", "Value": " 5 "}]
    assert latest(spark, record(items=items)) == {"rows_out_id": 9, "rows_out": 5}
    assert latest(spark, record(items=[{"ID": 1, "Name": "peak", "Value": "x"}])) == {"peak_id": 1}
    assert latest(spark, record(items=[{"ID": 1, "Name": "peak", "Value": "99999999999999999999"}])) == {"peak_id": 1}


def test_numbers_and_own_updates(spark):
    items = [{"ID": 1, "Name": "peak", "Update": "2", "Value": 7}]
    assert latest(spark, record(items=items)) == {"peak_id": 1, "peak": 7}
    assert latest(spark, record(items=items), field="Update") == {"peak_id": 1, "peak": 2}


def test_item_without_id_or_name_and_missing_list(spark):
    assert latest(spark, record(items=[{"Name": "peak", "Value": "1"}])) == {}
    assert latest(spark, record(items=[{"ID": 1, "Value": "1"}, {"ID": 2, "Name": "peak", "Value": "3"}])) == {"peak_id": 2, "peak": 3}
    assert latest(spark, record()) == {}
    assert latest(spark, "no json") == {}


def test_accumulable_struct_order_and_filter(spark):
    items = [{"ID": 1, "Name": "peak", "Value": "7"}]
    df = records(spark, record(items=items), record(items=items))
    rows = metrics.with_accumulables(df, ["Peak!", "none"], where="i = 1").collect()
    assert [row["i"] for row in rows] == [1]
    struct = rows[0]["task_accumulables"]
    assert struct.__fields__ == ["peak_", "peak__id", "none", "none_id"]
    assert metrics.accumulable_struct(["a"]).simpleString() == "struct<a:bigint,a_id:int>"
    assert rows[0]["i"] == 1


def test_keep_json(spark):
    row = metrics.with_metrics(records(spark, record({"A": 1})), ["a"], keep_json=True).first()
    assert json.loads(row["task_metrics_json"]) == {"a": 1}


def test_discover_keys(spark):
    df = records(spark, record({"A b": 1}, [{"ID": 1, "Name": "X y", "Value": "1"}]), record({"A b": 2}), "bad")
    found = {(row["kind"], row["name"]): row["records"] for row in metrics.discover_keys(df).collect()}
    assert found == {("metric", "a_b"): 2, ("accumulable", "x_y"): 1}


def test_default_keys_are_canonical_and_distinct():
    keys = TASK_METRIC_KEYS + ACCUMULABLE_KEYS
    assert len(TASK_METRIC_KEYS) == 33 and len(ACCUMULABLE_KEYS) == 124
    assert len(set(keys)) == len(keys)
    assert all(canonical_text(key) == key for key in keys)
    assert "executor_run_time" not in keys


def test_canonical_name_column_and_text_agree(spark):
    names = ["a-b  c", "Émile", "x__y", "", "___", "A(1)"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    from runsight.functions import canonical_name

    assert [row[0] for row in df.select(canonical_name(F.col("n"))).collect()] == [canonical_text(n) for n in names]


def test_outside_characters_are_listed_without_ranges(spark):
    from runsight.functions import canonical_name
    from runsight.functions.columns import OUTSIDE_NAME

    # Java tests ranges in turn, for each character of each name.
    assert "-" not in OUTSIDE_NAME
    names = ["".join(map(chr, range(1, 384))), "aªbⅠc\U0001d504d", "0-9 a-z A-Z"]
    df = spark.createDataFrame([(name,) for name in names], "n string")
    ranges = F.lower(F.regexp_replace("n", "[^a-zA-Z0-9_]+", "_"))
    assert df.filter(canonical_name("n") != ranges).count() == 0
    assert [row[0] for row in df.select(canonical_name("n")).collect()] == [canonical_text(name) for name in names]


def test_wanted_names_are_looked_up_in_a_set(spark):
    df = records(spark, record(items=[{"ID": 1, "Name": "peak memory usage", "Value": "3"}, {"ID": 2, "Value": "4"}]))
    df = df.select(metrics.latest_by_id("logMessage").alias("j"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
    assert json.loads(df.first()["j"]) == {"peak_memory_usage_id": 1, "peak_memory_usage": 3}
