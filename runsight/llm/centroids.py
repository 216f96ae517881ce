"""Centroid clustering by a vector-approximation file.

Vectors are turned into whole numbers and stored with an approximation: six bits for each dimension, which say between which two
marks the component lies. For a centroid, a lookup table gives the least and the largest squared distance that a cell can mean in its
dimension; the sums over a vector's cells are an interval for its distance. Where the interval of one centroid lies below all others, that is the
nearest, and the components are not looked at. Where intervals overlap, components are fetched and the distances to those
centroids computed exactly.

Approximation and components are in one row: a join that fetches some vectors by key would move more than the scan reads. All passes
are row by row; between them only sums travel, one row per centroid, dimension and task, so there is no group of vectors in any task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.sources.staging import stage

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
FIT_ROWS = 10_000
"""At most so many vectors, those with the least hash of their id, place the marks between cells."""
CELLS = 64
"""Cells of a dimension, one byte each."""
ROWS_AT_ONCE = 1024
PLAIN = 1 << 26
"""Below this, squared distances of up to 500 dimensions fit into 64 bits; vectors and centroids beyond are computed with Python's integers."""
SLACK = 1e-9
DIGIT = 1 << 40
"""Sums travel as digits of this base, so they are exact however many rows there are."""
MOST = (1 << 63) - 1


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exactly, as integers; as Python's where they are large."""
    if not values.size or np.abs(values).max() < PLAIN / scale:
        return np.floor(values * scale).astype(np.int64)
    # From 2^53 on a double is whole, and times the scale it may be no double any more.
    exact = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel()]
    return np.array(exact, object).reshape(values.shape)


@dataclass
class Cells:
    """The marks between the cells of each dimension, and the least and largest component in it."""

    marks: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(marks, column, side="right") for marks, column in zip(self.marks, vectors.T)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """For each dimension and cell, the least squared distances to the centroids, then the largest."""
        low = np.concatenate([self.least[:, None], self.marks], axis=1)[:, :, None].astype(float)
        high = np.concatenate([self.marks - 1, self.largest[:, None]], axis=1)[:, :, None].astype(float)
        at = centroids.T[:, None, :].astype(float)
        near = np.maximum(np.maximum(low - at, at - high), 0) ** 2
        far = np.maximum(np.abs(at - low), np.abs(at - high)) ** 2
        return np.concatenate([near, far], axis=2)


def place_marks(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For each dimension, `cells` - 1 marks: each value of the sample if these are few, else with about as many rows between them."""
    out = []
    for column in np.clip(sample, -PLAIN, PLAIN).astype(np.int64).T:
        values = np.unique(column)[1:]
        if len(values) >= cells:
            values = np.quantile(column, np.arange(1, cells) / cells, method="nearest")
        out.append(np.pad(values, (0, cells - 1 - len(values)), mode="edge") if len(values) else np.full(cells - 1, column[0]))
    return np.array(out, np.int64)


@dataclass
class Nearest:
    """Finds the nearest centroid. Ties go to the smaller number."""

    cells: Cells
    centroids: np.ndarray
    scale: int

    @cached_property
    def tables(self) -> np.ndarray | None:
        """Built in the tasks. None if the centroids are large, so that all vectors are fetched."""
        return None if self.centroids.dtype == object else self.cells.tables(self.centroids)

    def overlapping(self, codes: np.ndarray) -> np.ndarray:
        """Which centroids' intervals reach below the end of all others, for each approximation."""
        sums = np.zeros((len(codes), self.tables.shape[2]))
        for dimension, table in enumerate(self.tables):
            sums += table[codes[:, dimension]]
        near, far = np.split(sums, 2, axis=1)
        return near * (1 - SLACK) <= far.min(axis=1, keepdims=True) * (1 + SLACK)

    def assign(self, codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
        """The numbers of the nearest centroids, and how many vectors had to be fetched for that."""
        out, fetched = np.zeros(len(codes), np.int64), 0
        plain = np.abs(values).max(axis=1, initial=0) < PLAIN / self.scale
        for first in range(0, len(codes), ROWS_AT_ONCE):
            part = slice(first, first + ROWS_AT_ONCE)
            count = len(codes[part])
            open_to = np.ones((count, len(self.centroids)), bool)
            if self.tables is not None:
                open_to[plain[part]] = self.overlapping(codes[part][plain[part]])
            out[part] = open_to.argmax(axis=1)
            rows = np.flatnonzero(open_to.sum(axis=1) > 1)
            fetched += len(rows)
            if len(rows):
                out[first + rows] = self._exact(whole_numbers(values[part][rows], self.scale), open_to[rows])
        return out, fetched

    def _exact(self, vectors: np.ndarray, open_to: np.ndarray) -> np.ndarray:
        rows, numbers = np.nonzero(open_to)
        apart = vectors[rows] - self.centroids[numbers]
        distances = np.full(open_to.shape, math.inf, object) if apart.dtype == object else np.full(open_to.shape, MOST)
        distances[rows, numbers] = (apart * apart).sum(axis=1)
        return distances.argmin(axis=1)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _codes(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dimensions)


def _extent(dimensions: int, scale: int):
    """(dimension, rows, least, largest) of a task's vectors; those with a large component count as rows only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least, largest = 0, np.full(dimensions, PLAIN), np.full(dimensions, -PLAIN)
        for batch in batches:
            values = _matrix(batch.column("values"), dimensions)
            count += len(values)
            small = values[np.abs(values).max(axis=1, initial=0) < PLAIN / scale]
            if len(small):
                least = np.minimum(least, whole_numbers(small.min(axis=0), scale))
                largest = np.maximum(largest, whole_numbers(small.max(axis=0), scale))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array([count] * dimensions, pa.int64()), pa.array(least), pa.array(largest)], ["dimension", "n", "least", "largest"])

    return work


def _encoding(cells: Cells, dimensions: int, scale: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Cells of large components don't matter; such vectors are always fetched.
            values = np.clip(_matrix(batch.column("values"), dimensions), -PLAIN / scale, PLAIN / scale)
            codes = cells.encode(np.floor(values * scale).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in codes], pa.binary())], [*batch.schema.names, "code"])

    return work


def _summing(nearest: Nearest, dimensions: int):
    """(cluster, dimension, digit, value): the sums of a task's vectors. Dimension -1 counts the vectors, -2 those fetched."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(nearest.centroids)
        sums, counts, fetched = np.zeros((k, dimensions), object), np.zeros(k, np.int64), 0
        for batch in batches:
            values = _matrix(batch.column("values"), dimensions)
            number, looked_up = nearest.assign(_codes(batch.column("code"), dimensions), values)
            fetched += looked_up
            for cluster in np.unique(number):
                mine = number == cluster
                counts[cluster] += mine.sum()
                sums[cluster] += whole_numbers(values[mine], nearest.scale).sum(axis=0)
        rows = [(0, -2, 0, fetched)]
        for cluster in np.flatnonzero(counts):
            rows.append((cluster, -1, 0, counts[cluster]))
            for dimension, total in enumerate(sums[cluster]):
                rest, sign, digit = abs(int(total)), 1 if total > 0 else -1, 0
                while rest:
                    rest, value = divmod(rest, DIGIT)
                    rows.append((cluster, dimension, digit, sign * value))
                    digit += 1
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)], ["cluster", "dimension", "digit", "value"])

    return work


def _finishing(nearest: Nearest, dimensions: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("values"), dimensions)
            number, _ = nearest.assign(_codes(batch.column("code"), dimensions), values)
            distance = np.zeros(len(number), np.int64)
            for first in range(0, len(number), ROWS_AT_ONCE):
                part = slice(first, first + ROWS_AT_ONCE)
                apart = whole_numbers(values[part], nearest.scale) - nearest.centroids[number[part]]
                distance[part] = np.minimum((apart * apart).sum(axis=1), MOST)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return work


def _whole_array(rows: list[list[int]]) -> np.ndarray:
    """64 bits where that is enough for squared distances."""
    large = any(abs(x) > PLAIN for row in rows for x in row)
    return np.array(rows, object if large else np.int64)


def _next_centroids(sums: list, before: np.ndarray) -> np.ndarray:
    """The componentwise floor of the means; centroids without vectors stay."""
    counts, totals = {}, {}
    for row in sums:
        if row["dimension"] == -1:
            counts[row["cluster"]] = row["value"]
        elif row["dimension"] >= 0:
            place = (row["cluster"], row["dimension"])
            totals[place] = totals.get(place, 0) + row["value"] * DIGIT ** row["digit"]
    return _whole_array(
        [[totals.get((c, d), 0) // counts[c] for d in range(before.shape[1])] if c in counts else [int(x) for x in row] for c, row in enumerate(before)]
    )


def _hashed(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def _first_by_hash(kept: DataFrame, rows: int, of: int, seed: int) -> list:
    """The `rows` of all `of` vectors with the least hash of their id. Vectors of one id come in the order of their components."""
    hashed = kept.withColumn("_hash", _hashed(seed))
    order = [F.col("_hash").asc_nulls_last(), "values"]
    # The hashes are spread evenly, so twice the share holds enough of them; else all are sorted.
    share = min(1.0, 2 * rows / max(of, 1))
    below = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("long") < F.lit(int(share * 16**12))
    found = hashed.filter(below).orderBy(*order).limit(rows).select("values").collect()
    if len(found) < min(rows, of):
        found = hashed.orderBy(*order).limit(rows).select("values").collect()
    return [row["values"] for row in found]


def cluster_vectors(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    fit_rows: int = FIT_ROWS,
    fetched: list | None = None,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    `vectors` has vec_id and embedding. Kept are those with exactly `dimensions` components, none null or non-finite; each component x is
    floor(scale * x). The first centroids are the `k` vectors with the least sha256 of seed and vec_id; with fewer vectors there are
    fewer. Rows without an id are clustered too, but come last among these. Repeated rows count as often as they occur. Of
    several vectors with one id the one with the smallest components comes first. Distances and sums over 2^63 - 1 are given as that.
    An empty table gives no rows. `fetched` gets the number of vectors whose components were compared in each round.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.filter((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values"))
    extent = kept.select("values").mapInArrow(_extent(dimensions, scale), "dimension int, n long, least long, largest long")
    extent = extent.groupBy("dimension").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest")).orderBy("dimension").collect()
    if not extent:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sample = whole_numbers(np.array(_first_by_hash(kept, max(fit_rows, k), extent[0]["n"], seed)), scale)
    centroids = _whole_array([[int(x) for x in row] for row in sample[:k]])
    cells = Cells(place_marks(sample), np.array([row["least"] for row in extent]), np.array([row["largest"] for row in extent]))
    coded = stage(kept.mapInArrow(_encoding(cells, dimensions, scale), "vec_id long, values array<double>, code binary"), "coded_vectors")

    for _ in range(rounds):
        of_tasks = coded.select("values", "code").mapInArrow(_summing(Nearest(cells, centroids, scale), dimensions), "cluster int, dimension int, digit int, value long")
        # At most k rows for each dimension and digit are left.
        sums = of_tasks.groupBy("cluster", "dimension", "digit").agg(F.sum("value").alias("value")).collect()
        if fetched is not None:
            fetched.append(sum(row["value"] for row in sums if row["dimension"] == -2))
        centroids = _next_centroids(sums, centroids)

    assigned = stage(coded.mapInArrow(_finishing(Nearest(cells, centroids, scale), dimensions), "vec_id long, cluster int, distance long"), "assigned_vectors")
    totals = {row["cluster"]: int(row["sum"]) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()}
    by_cluster = F.array(*[F.lit(min(totals.get(c, 0), MOST)) for c in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest()) for row in centroids])
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).cast("long").alias("cluster_inertia"), F.lit(min(sum(totals.values()), MOST)).cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256")
    )
