from __future__ import annotations

import random

from pyspark.sql import functions as F

from runsight.operators.distinct_counts import common_bitmaps, distinct_counts, id_bitmaps, merge_bitmaps


def rows(seed, count=3000):
    dice = random.Random(seed)
    ids = lambda: dice.choice([dice.randint(0, 500), dice.randint(-40_000, 90_000), None, 2**40 + dice.randint(0, 9), -(2**63), 2**63 - 1])
    return [(dice.choice(["a", "b", None]), ids()) for _ in range(count)] + [("void", None)]


def sets(*tables):
    out = {}
    for g, i in (row for table in tables for row in table):
        if i is not None:
            out.setdefault(g, set()).add(i)
    return out


def counted(bitmaps, keys=("g",)):
    return {r["g"] if keys else None: r["num_distinct"] for r in distinct_counts(bitmaps, list(keys)).collect()}


def test_counts_of_one_table_of_several_and_of_all(spark):
    one, other = rows(1), rows(2)
    maps = [id_bitmaps(spark.createDataFrame(table, "g string, i long").repartition(5), ["g"], "i") for table in (one, other)]
    assert counted(maps[0]) == {g: len(ids) for g, ids in sets(one).items()}
    both = merge_bitmaps(maps, ["g"])
    assert counted(both) == {g: len(ids) for g, ids in sets(one, other).items()}
    assert counted(merge_bitmaps(both, []), ())[None] == len(set().union(*sets(one, other).values()))
    common = common_bitmaps(maps, ["g"])
    assert {g: n for g, n in counted(common).items() if n} == {g: len(ids & sets(other).get(g, set())) for g, ids in sets(one).items() if ids & sets(other).get(g, set())}


def test_empty_tables(spark):
    empty = id_bitmaps(spark.createDataFrame([], "g string, i int"), ["g"], "i")
    assert distinct_counts(merge_bitmaps([empty, empty], ["g"]), ["g"]).collect() == []


def test_ids_are_not_shuffled_again(spark, tmp_path):
    """Stored bitmaps of two tables meet by range of ids, and what is shuffled before is one row per task and range."""
    path = str(tmp_path / "maps")
    id_bitmaps(spark.range(100_000).withColumn("g", F.lit("a")), ["g"], "id").write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    plan = merge_bitmaps([stored, stored], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "bitmap_construct" not in plan
