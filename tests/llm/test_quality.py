from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import quality
from runsight.llm.quality import FEATURES, Trees, best_split, features_of, fit, fit_trees, score
from runsight.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def down(trees: Trees, values) -> float:
    """One row through each tree, node by node."""
    total = trees.start
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if values[feature[node]] > limit[node] else 1)
        total += leaf[node - len(feature)]
    return total


def data(seed, rows=400):
    dice = np.random.default_rng(seed)
    values = np.round(dice.normal(size=(rows, 5)), 1)
    return values, ((values[:, 1] > 0.3) ^ (values[:, 3] > 0)).astype(float)


def test_arrays_give_what_each_tree_gives():
    values, labels = data(0)
    trees = fit_trees(values, labels, trees=20)
    assert np.allclose(trees.margins(values), [down(trees, row) for row in values])
    assert ((trees.scores(values) > 0.5) == (labels == 1)).mean() > 0.97


def test_split_is_the_best_of_all():
    values, labels = data(1, 60)
    gradient, curvature = labels - 0.4, np.full(60, 0.24)
    limits = quality.bin_limits(values)
    binned = np.stack([np.searchsorted(of, column, side="left") for of, column in zip(limits, values.T)], axis=1)
    gain, feature, last = best_split(quality._histograms(binned, np.arange(60), gradient, curvature), least_rows=5)
    worth = lambda mask: gradient[mask].sum() ** 2 / (curvature[mask].sum() + quality.PENALTY)
    every = [
        worth(~after) + worth(after) - worth(np.ones(60, bool))
        for column, of in zip(values.T, limits)
        for limit in of
        if 5 <= (after := column > limit).sum() <= 55
    ]
    assert gain == pytest.approx(max(every)) and ((values[:, feature] > limits[feature][last]) == (binned[:, feature] > last)).all()


def test_one_kind_of_label_or_none_gives_one_score():
    values, labels = data(2)
    alike = fit_trees(values, np.ones(len(values))).scores(values)
    assert alike.min() == alike.max() > 0.9
    assert fit_trees(values[:0], labels[:0]).scores(values[:3]).tolist() == [0.5] * 3


def test_features_of_odd_texts():
    named = dict(zip(FEATURES, features_of("AB ab, ab. <x>\n\n12 é\n")))
    assert named["words"] == pytest.approx(np.log1p(6)) and named["upper_words"] == pytest.approx(1 / 6) and named["marked_words"] == pytest.approx(1 / 6)
    assert named["wordless"] == pytest.approx(1 / 6) and named["lines"] == pytest.approx(2 / 6) and named["commas"] == named["sentence_ends"] == pytest.approx(1 / 6)
    for text in (None, "", " \n\t", "\x00", "x" * 3_000_000, "a b " * 700_000, "\ud800"):
        values = features_of(text)
        assert len(values) == len(FEATURES) and np.isfinite(values).all()
    assert features_of(None) == features_of("")


def toy(spark, count=400):
    dice = random.Random(1)
    good = lambda: " ".join("".join(dice.choices("abcdefgh", k=dice.randint(2, 9))) for _ in range(60)) + "."
    texts = [good() if i % 3 else "BUY!! " * 50 + good().upper() for i in range(count)]
    return [(i, text) for i, text in enumerate(texts)], [(i, int(i % 3 > 0)) for i in range(count)]


def test_null_rows_copies_and_clashing_columns(spark):
    rows, labels = toy(spark)
    rows += [(None, "x"), (500, None), (501, ""), (3, rows[3][1]), (3, None)]
    labels += [(None, 1), (7, None), (9, 3), (3, 0), (3, 0), (10**6, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", F.lit(2).alias("quality"), F.lit("y").alias("features"), F.lit(1).alias("score"), F.lit(1).alias("hash"))
    trees = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = score(docs, trees).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    values = {r["doc_id"]: r["score"] for r in found}
    assert values[500] == values[501] and all((values[i] >= 0.7) == (i % 3 > 0) for i in range(400) if i != 3)
    again = fit(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int").repartition(3))
    assert {r["doc_id"]: r["score"] for r in score(docs, again).collect()} == values


def test_held_out_labels_and_surplus_rows_are_not_learned(spark):
    rows, labels = toy(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    wrong = frame.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = fit(docs, frame), fit(docs, wrong)
    assert all(np.array_equal(a, b) for a, b in ((one.feature, other.feature), (one.limit, other.limit), (one.leaf, other.leaf)))
    few = fit(docs, frame, fit_rows=40)
    assert few.leaf.shape == one.leaf.shape and not np.array_equal(few.leaf, one.leaf)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    trees = fit(docs, labels)
    assert score(docs, trees).collect() == []
    assert score(spark.createDataFrame([(1, "x")], SCHEMA), trees).first()["score"] == 0.5


def test_held_out_rows_of_the_query(spark):
    found = QUERIES["op11_quality"](spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = sum(row["predicted"] == row["quality"] for row in found)
    assert len(found) > 50 and right / len(found) >= 0.95
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7) for row in found)
