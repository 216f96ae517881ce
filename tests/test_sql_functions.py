from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from runsight.functions import canonical_name, format_epoch_ms, pct
from runsight.functions.sql import register_sql_functions
from runsight.operators.metrics import flatten_int_json, latest_by_id

ITEMS = [
    {"ID": 5, "Name": "rows read", "Value": "7", "Update": "1"},
    {"ID": 9, "Name": "Rows (read", "Value": " 12 ", "Update": "x"},
    {"ID": 9, "Name": "other", "Value": "3"},
    {"ID": 11, "Name": "peak", "Value": "1.5"},
]
RECORDS = [
    json.dumps({"Task Metrics": {"Run Time": 5, "Input Metrics": {"Records Read": 2, "Deep": {"X": 1, "Y": {"Z": 2}}}, "Share": 0.5, "T": True, "N": None}}),
    json.dumps({"Task Info": {"Accumulables": ITEMS}, "Task Metrics": {}}),
    json.dumps({"Task Info": {"Accumulables": [*ITEMS, {"Name": "rows read", "Value": "1"}]}}),
    json.dumps({"Task Info": {"Accumulables": []}}),
    "{bad",
    "",
    None,
]
NAMES = ["rows read", "PEAK"]


@pytest.fixture(scope="module")
def records(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "i int, record string")
    df.createOrReplaceTempView("records")
    return df


def both(spark, sql, df):
    assert sorted(map(tuple, spark.sql(sql).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_records_give_what_the_columns_give(spark, records):
    both(spark, "SELECT i, flatten_metrics(record) FROM records", records.select("i", flatten_int_json("record")))
    for name, field in (("latest_values", "Value"), ("latest_updates", "Update")):
        both(spark, f"SELECT i, {name}(record, array('rows read', 'PEAK')) FROM records", records.select("i", latest_by_id("record", NAMES, field=field)))
    found = spark.sql("SELECT flatten_metrics(record) FROM records WHERE i = 0").first()[0]
    assert json.loads(found) == {"run_time": 5, "input_metrics__records_read": 2, "input_metrics__deep__x": 1}


def test_plain_values_give_what_the_columns_give(spark, records):
    both(spark, "SELECT canonical_name(record) FROM records", records.select(canonical_name("record")))
    both(spark, "SELECT epoch_ms_text(i * 86400123) FROM records", records.select(format_epoch_ms(F.col("i") * 86400123)))
    both(spark, "SELECT percent_of(i, i - 1) FROM records", records.select(pct(F.col("i").cast("double"), (F.col("i") - 1).cast("double"))))


def test_plan_holds_no_python(spark, records, capsys):
    spark.sql("SELECT from_json(flatten_metrics(record), 'run_time BIGINT').run_time AS t FROM records WHERE canonical_name(record) <> 'x'").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "SQLScalarFunction" not in plan


def test_prefix_and_replacement(spark, records):
    assert register_sql_functions(spark, "rs_")[0] == "rs_canonical_name"
    register_sql_functions(spark, "rs_")
    assert spark.sql("SELECT rs_canonical_name('A b')").first()[0] == "a_b"
