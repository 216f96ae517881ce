"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o, rotated at random, is stored as the signs of its D components and one correction factor f = <s, o>, where s is the
unit vector of the signs. For a rotated query q, <s, q> / f is an unbiased estimate of <o, q>, with an error of about
sqrt((1 - f^2) / f^2 / (D - 1)). Only pairs whose estimate is within `SIGMAS` such errors of the limit, or above it, are computed
exactly, in double precision.

Equal vectors of one label are one node with a count. Each label is dealt into blocks of bounded size, and each pair of blocks is one
group, so a label with a third of all rows is many groups. A group returns a count and the end of a star per vector, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.components import connected_components
from runsight.llm.text import hash_pair
from runsight.sources.staging import stage

SIGMAS = 6.0
BLOCK = 1500
EXACT_AT_ONCE = 50_000
_NODE = ("label", "_a", "_b")


@lru_cache(maxsize=4)
def rotation(dimensions: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dimensions).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a largest component between 1/2 and 1, by powers of two: no square of a component overflows, or is lost beside others."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and correction factors."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rotated = unit @ rotation(vectors.shape[1]).T
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(vectors.shape[1])


def upper_bounds(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, sigmas: float = SIGMAS) -> np.ndarray:
    """For each coded vector (row) and query vector (column), the upper confidence bound of their cosine."""
    d = queries.shape[1]
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    rotated = (unit @ rotation(d).T).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    estimate = (signs @ rotated.T) / (np.sqrt(d) * factors[:, None])
    error = np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(d - 1, 1))
    return estimate + sigmas * error[:, None] + 1e-5


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, factors = [], []
        for vector in batch.column("embedding"):
            code, factor = encode(scaled(vector.values.to_numpy(zero_copy_only=False).astype(np.float64)[None, :]))
            codes.append(code.tobytes())
            factors.append(factor[0])
        columns = [*batch.columns, pa.array(codes, pa.binary()), pa.array(factors, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code", "factor"])


def _linked(codes, factors, vectors, low, high, limit: float) -> np.ndarray:
    """Which of the vectors `low` are linked with which of `high`."""
    likely = upper_bounds(codes[low], factors[low], vectors[high]) >= limit
    found = np.zeros(likely.shape, bool)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    i, j = np.nonzero(likely)
    for start in range(0, len(i), EXACT_AT_ONCE):
        a, b = i[start : start + EXACT_AT_ONCE], j[start : start + EXACT_AT_ONCE]
        dots = np.einsum("nd,nd->n", vectors[low[a]], vectors[high[b]])
        found[a, b] = dots / (norms[low[a]] * norms[high[b]]) >= limit
    return found


def _block_links(limit: float):
    def work(table: pa.Table) -> pa.Table:
        ids, many, own = (table.column(c).to_numpy() for c in ("rep", "n", "_own"))
        vectors = scaled(np.stack([v.values.to_numpy(zero_copy_only=False) for v in table.column("embedding")]).astype(np.float64))
        codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in table.column("code")])
        factors = table.column("factor").to_numpy()
        low, high = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        same = own.min() == own.max()
        if same and table.column("low")[0] != table.column("high")[0]:
            return pa.table({"rep": ids[:0], "links": many[:0], "root": ids[:0]})
        linked = _linked(codes, factors, vectors, low, high, limit)
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[low] = linked @ many[high]
        if not same:
            links[high] = linked.T @ many[low]
        root, most = ids.copy(), np.iinfo(np.int64).max
        while True:
            before = root.copy()
            root[low] = np.minimum(root[low], np.where(linked, root[high][None, :], most).min(axis=1))
            root[high] = np.minimum(root[high], np.where(linked, root[low][:, None], most).min(axis=0))
            if (before == root).all():
                break
        tied = links > 0
        return pa.table({"rep": ids[tied], "links": links[tied], "root": root[tied]})

    return work


def near_duplicate_vectors(vectors: DataFrame, limit: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    `vectors` has vec_id, embedding, label. Vectors are compared if their labels are equal and not null and they have as many
    components; those with a cosine of at least `limit` are linked. Null, empty and zero vectors, vectors with a null or non-finite
    component and rows without vec_id are linked with nothing. `n_links` counts the other rows linked directly, copies included;
    a component is named by its smallest vec_id. Rows of one vec_id with different vectors are one vector, linked through any of
    them, and have the sum of their links. Empty tables give no rows.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(values, lambda x: x != 0)
    first, second = hash_pair(F.size("embedding"), F.col("embedding"))
    every = vectors.select(
        F.col("vec_id").cast("long"), "embedding", "label", F.coalesce(usable, F.lit(False)).alias("_usable"), first.alias("_a"), second.alias("_b")
    )
    nodes = every.filter("_usable").groupBy(*_NODE).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    coded = stage(nodes.mapInArrow(_coded, nodes.schema.simpleString()[7:-1] + ",code:binary,factor:double"), "coded_vectors")

    kind = ["label", "_dimensions"]
    sized = coded.withColumn("_dimensions", F.size("embedding"))
    counts = sized.groupBy(*kind).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = sized.join(counts, kind).withColumn("_own", F.pmod("_a", F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select(*kind, F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), "_own", "rep", "n", "embedding", "code", "factor")
    links = stage(met.groupBy(*kind, "low", "high").applyInArrow(_block_links(limit), "rep long, links long, root long"), "vector_links")

    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.select("rep", "root")).toDF("rep", "component")
    own = coded.select(*_NODE, "rep", "n").join(totals, "rep", "left").join(components, "rep", "left")
    node = own.select(*_NODE, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = every.select("vec_id", "_usable", *[F.when(F.col("_usable"), F.col(c)).alias(c) for c in _NODE])
    found = rows.join(node, list(_NODE), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
