from __future__ import annotations

import random

import pytest

from runsight.operators.skew import join_splitting_hot


@pytest.mark.parametrize("most, salts", [(1, 4), (100, 32), (0, 2)])
def test_split_join_gives_the_rows_of_a_plain_one(spark, most, salts):
    dice = random.Random(most)
    rows = [(dice.choice(["hot", "hot", "hot", "b", "c", None, "only left"]), i % 3, i) for i in range(900)] + [("hot", 0, 7)] * 5
    left = spark.createDataFrame(rows, "k string, j int, v int")
    right = left.groupBy("k", "j").count().filter("k <> 'only left' OR k IS NULL").union(spark.createDataFrame([("only right", 1, 3)], "k string, j int, n long"))
    found = join_splitting_hot(left, right, ["k", "j"], "count", salts=salts, most=most)
    expected = left.join(right, ["k", "j"])
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(map(repr, found.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_the_heaviest_key_is_cut(spark):
    left = spark.range(20_000).selectExpr("IF(id < 15000, 0, id) AS k", "id AS v").repartition(4)
    right = left.groupBy("k").count()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = join_splitting_hot(left, right, ["k"], "count", most=10).selectExpr("spark_partition_id() AS p", "k").filter("k = 0")
        assert found.groupBy("p").count().count() > 3 and found.count() == 15_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
