from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import centroids
from runsight.llm.centroids import cluster_vectors

SCHEMA = "vec_id long, embedding array<double>"


def plainly(rows, k, rounds, dimensions, scale=64, seed=1):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in order[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(middles)), key=lambda c: (apart(v, middles[c]), c))
    for _ in range(rounds):
        numbers = [nearest(v) for _, v in kept]
        groups = [[v for (_, v), n in zip(kept, numbers) if n == c] for c in range(len(middles))]
        middles = [[sum(x) // len(group) for x in zip(*group)] if group else middle for group, middle in zip(groups, middles)]
    out = []
    for i, v in kept:
        c = nearest(v)
        out.append((i, c, apart(v, middles[c]), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()))
    most = 2**63 - 1
    inertia = [sum(min(d, most) for _, n, d, _ in out if n == c) for c in range(len(middles))]
    return [(i, c, min(d, most), min(inertia[c], most), min(sum(inertia), most), digest) for i, c, d, digest in out]


def check(spark, rows, k=5, rounds=3, dimensions=4, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = cluster_vectors(docs, k=k, rounds=rounds, dimensions=dimensions, **options).collect()
    expected = plainly(rows, k, rounds, dimensions)
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_plain_clustering(spark, seed):
    dice = random.Random(seed)
    spread = [0.03, 1.0, 40.0][seed]
    rows = [(i, [dice.gauss(0, spread) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.4]), (5, [9.0, 9.0, 9.0, 9.0])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("-inf"), 0.0, 0.0, 0.0])]
    check(spark, rows, fit_rows=[10_000, 50, 5][seed])


def test_ties_copies_and_empty_centroids(spark):
    # Few places, each with many copies: centroids fall together, and those with the larger number stay empty.
    rows = [(i, [float(i % 3), 0.0, 0.0, float(i % 2)]) for i in range(240)]
    found = check(spark, rows, k=12)
    assert len({row["cluster"] for row in found}) <= 6


def test_large_components_are_exact(spark):
    dice = random.Random(4)
    rows = [(i, [dice.choice([1e-3, 1.0, 1e6, 1e9, -1e15, 1e200]) * dice.random() for _ in range(4)]) for i in range(60)]
    rows += [(100, [1.7e308, -1.7e308, 0.0, 0.0]), (101, [1.7e308, 1.7e308, 0.0, 0.0])]
    check(spark, rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.5, 0.5, 0.5, 0.5]), (2, [0.0, 0.0, 0.0, -0.5])], k=16)
    empty = cluster_vectors(spark.createDataFrame([], SCHEMA))
    full = cluster_vectors(spark.createDataFrame([(1, [0.5] * 64)], SCHEMA))
    assert empty.collect() == [] and [f.dataType for f in empty.schema] == [f.dataType for f in full.schema] and empty.columns == full.columns


def test_float_arrays_and_clashing_columns(spark):
    rows = [(i, [((i * 37 + d * 11) % 101 - 50) / 64 for d in range(4)]) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(1).alias("cluster"), F.lit("x").alias("values"), F.lit(0).alias("_hash"))
    found = cluster_vectors(docs, k=5, rounds=3, dimensions=4).collect()
    assert sorted(map(tuple, found)) == sorted(plainly(rows, 5, 3, 4))


def test_intervals_hold_the_distance_and_spare_most_vectors(spark):
    dice = np.random.default_rng(2)
    vectors = np.floor(dice.normal(0, 1, (2000, 64)) * 8).astype(np.int64)
    middles = vectors[:16]
    cells = centroids.Cells(centroids.place_marks(vectors[:500]), vectors.min(axis=0), vectors.max(axis=0))
    codes = cells.encode(vectors)
    sums = sum(table[codes[:, d]] for d, table in enumerate(cells.tables(middles)))
    exact = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
    near, far = np.split(sums, 2, axis=1)
    assert (near <= exact).all() and (exact <= far).all()
    fetched = []
    rows = spark.createDataFrame([(i, [float(x) / 64 for x in v]) for i, v in enumerate(vectors)], SCHEMA)
    assert cluster_vectors(rows, fetched=fetched).count() == 2000
    assert len(fetched) == 3 and max(fetched) < 600
