"""Quality scores by histogram gradient-boosted trees over statistics of whole texts.

Each text is described by a fixed set of shares and counts, computed where the text lies; only these go on. The trees are fitted to a
bounded sample of labelled rows: features are binned once, and each split is chosen from histograms of gradients over the bins, with
the sibling's histogram by subtraction. All trees have one depth and lie in three arrays, as heaps: a batch of texts goes down all trees at
once, a level per step.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.toxicity import held_out
from runsight.sources.staging import stage

FIT_ROWS = 20_000
"""At most so many labelled ids are used to fit the trees, those with the least hash."""
BINS, DEPTH, TREES, RATE = 64, 4, 150, 0.1
LEAST_ROWS, PENALTY = 8, 1.0
PIECE = 1 << 20
"""Bytes of a text whose counts are taken at once."""

_USUAL = ".,;:'\"-()?!"
_LETTER_BYTES = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_OTHER_BYTES = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in _USUAL for b in range(256)])
_OTHER = re.compile("[" + re.escape("".join(chr(b) for b in np.flatnonzero(_OTHER_BYTES))) + "]")
_REPEATED = re.compile(r"(\S)\1{3,}")

FEATURES = (
    "words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "top_word", "top_ten_words", "distinct_pairs", "stutter",
    "upper_words", "title_words", "wordless", "marked_words", "sentence_ends", "commas", "letters", "upper_letters", "digits", "spaces", "usual_signs",
    "other_signs", "top_other_sign", "wide_bytes", "entropy", "compression", "lines", "words_a_line", "distinct_lines", "ended_lines", "short_lines", "runs_of_signs",
)


def _bytes_of(data: bytes) -> tuple[np.ndarray, int]:
    """How often each byte occurs, and the size of the compressed text."""
    counts, packer, size = np.zeros(256, np.int64), zlib.compressobj(1), 0
    for first in range(0, len(data), PIECE):
        piece = data[first : first + PIECE]
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        size += len(packer.compress(piece))
    return counts, size + len(packer.flush())


def features_of(text: str | None) -> list[float]:
    """The values of FEATURES. Null and empty texts, and those of spaces only, have zeros but for their spaces."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    counts, packed = _bytes_of(data)
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    most = sorted(often.values(), reverse=True)[:10]
    distinct_pairs = len(set(pairwise(words))) / max(1, len(words) - 1)
    # Each distinct word is looked at once.
    upper = title = wordless = marked = ends = commas = 0
    for word, k in often.items():
        upper += k * (word.isupper() and len(word) > 1)
        title += k * word.istitle()
        wordless += k * (not any(map(str.isalpha, word)))
        marked += k * (_OTHER.search(word) is not None)
        ends += k * word.endswith((".", "?", "!"))
        commas += k * word.endswith((",", ";"))
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(1, len(lines))
    shares = counts[counts > 0] / size
    letters = max(1, int(counts[_LETTER_BYTES].sum()))
    return [
        float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float((lengths > 14).mean()), float((lengths <= 3).mean()),
        len(often) / n, most[0] / n if most else 0.0, sum(most) / n, distinct_pairs, sum(a == b for a, b in pairwise(words)) / n,
        upper / n, title / n, wordless / n, marked / n, ends / n, commas / n, letters / size, int(counts[65:91].sum()) / letters, int(counts[48:58].sum()) / size,
        int(counts[[9, 10, 11, 12, 13, 32]].sum()) / size, int(sum(counts[ord(c)] for c in _USUAL)) / size, int(counts[_OTHER_BYTES].sum()) / size, int(counts[_OTHER_BYTES].max()) / size,
        int(counts[128:].sum()) / size, float(-(shares * np.log2(shares)).sum()) if len(shares) else 0.0, packed / size if data else 0.0,
        len(lines) / n, len(words) / m, len(set(lines)) / m, sum(line.rstrip().endswith((".", "?", "!")) for line in lines) / m, sum(len(line) < 30 for line in lines) / m,
        sum(len(found.group()) for found in _REPEATED.finditer(text)) / size,
    ]


@dataclass
class Trees:
    """Trees of one depth as heaps: node i of a tree has the children 2i + 1 and 2i + 2, and a value above its limit goes to the second."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each row, all trees at once."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(values), self.start)
        tree, row = np.arange(trees)[None, :], np.arange(len(values))[:, None]
        node = np.zeros((len(values), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (values[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.start + self.leaf[tree, node - inner].sum(axis=1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(values)))


def bin_limits(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Up to `bins` - 1 limits of each feature, between neighbouring values, with about as many rows between them."""
    out = []
    for column in values.T:
        distinct = np.unique(column)
        if len(distinct) > bins:
            distinct = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((distinct[:-1] + distinct[1:]) / 2)
    return out


def _histograms(binned: np.ndarray, rows: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Sums of gradient and curvature, and rows, for each feature and bin."""
    places = (binned[rows] + np.arange(binned.shape[1]) * BINS).ravel()
    total = binned.shape[1] * BINS
    weights = [np.repeat(gradient[rows], binned.shape[1]), np.repeat(curvature[rows], binned.shape[1]), None]
    return np.stack([np.bincount(places, w, total) for w in weights]).reshape(3, -1, BINS)


def best_split(histogram: np.ndarray, least_rows: int = LEAST_ROWS, penalty: float = PENALTY) -> tuple[float, int, int]:
    """(gain, feature, last bin of the first child) of the split that gains most; the gain is 0 if none does."""
    left = np.cumsum(histogram, axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    worth = lambda part: part[0] ** 2 / (part[1] + penalty)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[2] < least_rows) | (right[2] < least_rows)] = 0
    feature, last = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[feature, last]), int(feature), int(last)


def fit_trees(values: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Newton boosting of the logistic loss. With labels of one kind only there are no trees, and all rows have that share as score."""
    inner = 2**depth - 1
    share = (labels.sum() + 1) / (len(labels) + 2)
    start = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    limits = bin_limits(values)
    binned = np.stack([np.searchsorted(of, column, side="left") for of, column in zip(limits, values.T)], axis=1)
    margin = np.full(len(labels), start)
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = labels - p, p * (1 - p)
        nodes = {0: (np.arange(len(labels)), None)}
        for node in range(inner):
            rows, histogram = nodes.pop(node)
            # Where nothing is gained, all rows go to the first child, by a limit that no value is above.
            first, second, below = rows, rows[:0], None
            if len(rows) >= 2 * LEAST_ROWS:
                histogram = _histograms(binned, rows, gradient, curvature) if histogram is None else histogram
                gain, column, last = best_split(histogram)
                if gain > 1e-6:
                    feature[tree, node], limit[tree, node] = column, limits[column][last]
                    after = binned[rows, column] > last
                    first, second = rows[~after], rows[after]
                    small = min(first, second, key=len)
                    of_small = _histograms(binned, small, gradient, curvature)
                    below = [of_small, histogram - of_small] if small is first else [histogram - of_small, of_small]
            below = below or [histogram, None]
            nodes[2 * node + 1], nodes[2 * node + 2] = (first, below[0]), (second, below[1])
        for node, (rows, _) in nodes.items():
            leaf[tree, node - inner] = value = rate * gradient[rows].sum() / (curvature[rows].sum() + PENALTY)
            margin[rows] += value
    return Trees(feature, limit, leaf, start)


def _describing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns of a batch, with the features of its text in place of that."""
    for batch in batches:
        values = pa.array([features_of(text.as_py()) for text in batch.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([values if name == "text" else batch.column(name) for name in batch.schema.names], ["features" if name == "text" else name for name in batch.schema.names])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Fits the trees to labelled documents that aren't held out.

    `labels` has doc_id and quality (0 or 1; other rows are ignored). Of ids with several labels the largest counts, and of documents
    with one id the one whose text has the least hash. At most `fit_rows` ids are used, and as many rows of features come to the driver.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = stage(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "quality_sample")
    # The chosen ids are no more than `fit_rows`, whatever the tables hold.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("hash"), "text")
    described = sample.mapInArrow(_describing, "doc_id long, quality int, hash long, features array<double>")
    once = described.groupBy("doc_id").agg(F.min(F.struct("hash", "quality", "features")).alias("row")).select("row.quality", "row.features", "doc_id")
    rows = sorted(once.collect(), key=lambda row: row["doc_id"])
    values = np.array([row["features"] for row in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(values, np.array([row["quality"] for row in rows], float))


def _scoring(trees: Trees):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                values = np.array([features_of(text.as_py()) for text in part.column("text")], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(trees.scores(values))], ["doc_id", "score"])

    return work


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1, higher: label 1 likelier).

    Each row is scored by its whole text alone. Null and empty texts have one score; repeated rows have repeated scores, rows without an
    id have one too. Other columns are left out.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scoring(trees), "doc_id long, score double")
