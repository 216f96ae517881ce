"""Near-duplicate documents by MinHash.

1. Each text becomes its set of word shingles, its universal-hash minima (the signature) and the hashes of its signature's bands. Texts
   with equal sets are one node from here on, so copies cost nothing more.
2. Documents that share a band are candidates. Small buckets give all their pairs. In a large bucket, each member is paired with the
   most central one only, that is, the one in the largest buckets: near copies of one text mostly meet there.
3. Candidates whose signatures agree well enough are verified on their full sets, and links become components.
4. What is left are large buckets with members in several components. These are compared block by block inside tasks, which return
   a star per component instead of pairs. So no link between candidates is lost, and nothing grows with the square of a bucket but
   the arithmetic inside these tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.components import connected_components
from runsight.llm.text import whole_row
from runsight.operators.skew import join_splitting_hot
from runsight.sources.staging import stage

ROWS, BANDS = 4, 20
"""A pair of similarity 0.85 shares no band with probability (1 - 0.85^4)^20 = 4e-7, one of 0.8 with 3e-5."""
SIGMAS = 6
"""A signature speaks against a pair if it is so many standard deviations below the limit."""
SMALL_BUCKET = 8
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1000, 1_000_000
COLUMNS = 2048

_MIXERS = np.random.default_rng(2024).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = np.random.default_rng(7).integers(0, 2**64, (2, ROWS * BANDS), dtype=np.uint64, endpoint=False)
FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
SETS = "doc_id long, n_shingles long, shingles array<long>"


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words as sorted 64-bit hashes; of a shorter text, its whole sequence.

    Words are runs of bytes other than ASCII whitespace, A-Z in lower case, which is what `bytes.split` and `bytes.lower` mean by these.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(words))], np.uint64)
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed += hashes[i : len(mixed) + i] * _MIXERS[i]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each hash (a x + b mod 2^64) / 2^32 of the family, universal on 32-bit values, its least value over the set."""
    found = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    values = shingles >> np.uint64(32)
    for start in range(0, len(values), 4096):
        hashed = np.multiply.outer(_HASHES[0], values[start : start + 4096]) + _HASHES[1][:, None]
        np.minimum(found, hashed.min(axis=1), out=found)
    return (found >> np.uint64(32)).astype(np.uint32)


def _features(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, keys, signatures, bands = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                shingles = shingle_set(text, size)
                ids.append(doc_id)
                counts.append(len(shingles))
                if not len(shingles):
                    keys.append((None, None))
                    signatures.append(None)
                    bands.append([])
                    continue
                low = minima(shingles)
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())
                signatures.append(low.astype(np.uint8).tobytes())
                hashed = [xxhash.xxh3_64_intdigest(part.tobytes(), seed=i) for i, part in enumerate(low.reshape(BANDS, ROWS))]
                bands.append(np.array(hashed, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
            )

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Sets are larger than texts: a few at a time.
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(text, size).view(np.int64) for text in part.column(1).cast(pa.binary()).to_pylist()]
                lengths = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), lengths, pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "shingles"]
                )

    return work


def _agreeing(least: int):
    """Keeps pairs whose signatures agree in at least `least` places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return work


def _block_stars(percent: int):
    """Links among a block's documents, as a star for each of the block's components."""

    def work(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = table.column("shingles").combine_chunks()
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, column, count = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        wanted = shared[column]
        rows, columns = owner[wanted], place[column[wanted]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for start in range(0, int(shared.sum()), COLUMNS):
            low, high = np.searchsorted(columns, (start, start + COLUMNS))
            held = np.zeros((len(ids), COLUMNS), np.float32)
            held[rows[low:high], columns[low:high] - start] = 1
            common += held @ held.T
        linked = 100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - common.astype(np.int64))
        root = ids.copy()
        while True:
            # The least root among the linked documents, until nothing changes.
            least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            least = np.minimum(least, root)
            if (least == root).all():
                break
            root = least
        tied = root != ids
        return pa.table({"a": ids[tied], "b": root[tied]})

    return work


def _least_agreement(percent: int) -> int:
    n, p = ROWS * BANDS, percent / 100
    return max(0, int(n * p - SIGMAS * (n * p * (1 - p)) ** 0.5))


def features(docs: DataFrame, size: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features(size), FEATURES)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct shingles of `size` words have 100 * intersection >= `percent` * union; a component is
    named by its smallest id, and that document is `kept`. Texts without words and rows without an id are linked with nothing; the
    latter have no component and are kept. Repeated rows share all values. Rows of one id with different texts are one document,
    linked through any of them. Empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    every = stage(features(docs, size), "minhash")
    known = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "minhash_nodes")
    links = stage(_links(docs, nodes, size, percent), "minhash_links")
    components = connected_components(links)
    # Rows of one id that fell into several sets are tied as well.
    ids = known.join(nodes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    found = ids.join(components, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    found = found.groupBy("doc_id").agg(F.min("component").alias("component"))
    result = every.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    rows = nodes.select("rep", "n_shingles", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("bucket"), F.sum("n_shingles").alias("weight")).filter("bucket > 1")
    # The largest buckets are dealt to several tasks each.
    buckets = stage(buckets, "minhash_buckets")
    members = stage(join_splitting_hot(rows, buckets, ["band"], "bucket"), "minhash_members")

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), SETS), "minhash_sets")

    small, large = members.filter(F.col("bucket") <= SMALL_BUCKET), members.filter(F.col("bucket") > SMALL_BUCKET)
    a, b = small.select("band", F.col("rep").alias("a")), small.select("band", F.col("rep").alias("b"))
    pairs = a.join(b, "band").filter("a < b").select("a", "b")
    central = large.groupBy("rep").agg(F.sum("bucket").alias("central"))
    pivots = large.join(central, "rep").groupBy("band").agg(F.max(F.struct("central", -F.col("rep"))).alias("top"), F.count(F.lit(1)).alias("_members"))
    pivots = stage(pivots.select("band", (-F.col("top.col2")).alias("pivot"), "_members"), "minhash_pivots")
    stars = join_splitting_hot(large, pivots, ["band"], "_members").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    pairs = pairs.union(stars).distinct()

    signatures = nodes.select("rep", "signature")
    signed = pairs.join(signatures.toDF("a", "signature_a"), "a").join(signatures.toDF("b", "signature_b"), "b").select("a", "b", "signature_a", "signature_b")
    likely = signed.mapInArrow(_agreeing(_least_agreement(percent)), "a long, b long").distinct()
    links = stage(_verified(likely, sets, percent).distinct(), "minhash_verified")

    components = connected_components(links)
    placed = large.join(components, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    mixed = stage(mixed, "minhash_mixed")
    blocks = F.greatest(F.ceil(F.col("bucket") / BLOCK_DOCUMENTS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    left = large.join(mixed, "band", "left_semi").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    # A block meets each other block once; a bucket of one block meets itself.
    others = F.when(F.col("_blocks") == 1, F.array("_own")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_own")))
    met = left.select("band", "rep", "_own", F.explode(others).alias("_other"))
    met = met.select("band", F.col("rep").alias("doc_id"), F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"))
    stars = met.join(sets, "doc_id").groupBy("band", "low", "high").applyInArrow(_block_stars(percent), "a long, b long")
    return links.union(stars.distinct())


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which `near_duplicates` keeps one per component: that with the smallest id.

    Rows without an id all stay. Of several rows of one id, that with the smallest text stays.
    """
    found = near_duplicates(docs, size, percent).filter("kept AND doc_id IS NOT NULL")
    kept = found.groupBy(F.col("doc_id").alias("_kept")).agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    known = docs.filter("doc_id IS NOT NULL").select(whole_row(docs)).join(kept, F.col("_all.doc_id") == F.col("_kept"))
    # Texts are only compared where an id is repeated.
    order = Window.partitionBy("_kept").orderBy(F.when(F.col("_repeated"), F.col("_all.text")).asc_nulls_last())
    one = known.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("_all.*")
    return one.unionByName(docs.filter("doc_id IS NULL"))
