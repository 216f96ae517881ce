"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The corpus labels documents, so token labels are derived first: a word that occurs in toxic documents in many contexts, far more than
in others, is a toxic token there; so is one that begins like many such words, as inflected words do. All fitting takes a bounded
sample of labelled rows. The field has two tags; a tag's score depends on the word, on its neighbours, and on the tag before.
Forward-backward marginals of all tokens make up the document's score, and tokens tagged as toxic are reported with their offsets.

Only words of the field's vocabulary carry weights. Between them all steps are alike, so the messages pass such a stretch by a power of
one matrix: exact for texts of any length, at the cost of the vocabulary's words in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.sources.staging import stage

FIT_ROWS = 8_000
"""At most so many labelled rows are used to fit the model, those with the least hash of their id."""
VOCABULARY = 5_000
LEAST_CONTEXTS, LEAST_LOG_ODDS, LEAST_Z = 5, 1.5, 3.0
REACH = 8
"""Tokens on either side of a vocabulary word that a training sequence holds."""
PREFIXES = range(4, 9)
MOST_KEPT = 500_000
STRETCH = 256
"""From here on, powers of the step matrix differ by less than rounding."""
MARGINAL = 0.5

_SPACES = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")
SCORED = "doc_id long, score double, toxic_tokens long, spans array<struct<start:int,end:int,marginal:double>>"


def tokens_of(text: str | None) -> list[bytes]:
    """The tokens in lower case: runs of ASCII letters and digits and characters outside ASCII, as TOKEN finds them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def word_features(word: str) -> list[str]:
    """The word, and its beginnings, marked as such."""
    return [word, *(word[:n] + "+" for n in PREFIXES if n < len(word))]


class Numbers(dict):
    """Word numbers by token: the least number among those of its features, 0 if none has one. Keeps what it has looked up."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        found = [n for f in word_features(token.decode("utf-8", "surrogatepass")) if (n := self.vocabulary.get(f))]
        self[token] = number = min(found, default=0)
        return number

    def __reduce__(self):
        return Numbers, (self.vocabulary,)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]]]:
        """Number of tokens, and (position, word number) of those that have one."""
        numbers = np.fromiter(map(self.__getitem__, tokens := tokens_of(text)), np.int32, len(tokens))
        places = np.flatnonzero(numbers)
        return len(tokens), list(zip(places.tolist(), numbers[places].tolist()))


@dataclass
class Model:
    numbers: Numbers
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray
    """Log score of a tag (column) after a tag (row)."""
    document: np.ndarray
    """Bias and weights of `document_features`."""

    def emission(self, words: np.ndarray) -> np.ndarray:
        """Log odds of the toxic tag by the words alone; `words` are numbers, padded by one on either side."""
        return self.bias + self.own[words[..., 1:-1]] + self.before[words[..., :-2]] + self.after[words[..., 2:]]

    def __post_init__(self):
        step = np.exp(self.moves) * np.array([1, np.exp(self.bias)])
        powers = [np.eye(2)]
        for _ in range(STRETCH):
            power = powers[-1] @ step
            powers.append(power / power.sum())
        self.powers = powers

    def marginals(self, count: int, hits: list[tuple[int, int]]) -> list[tuple[int, float]]:
        """(position, probability of the toxic tag) of vocabulary words and their neighbours, by forward-backward over all tokens."""
        number = dict(hits)
        places = sorted({p for i, _ in hits for p in (i - 1, i, i + 1) if 0 <= p < count})
        odds = [
            self.bias + self.own[number.get(p, 0)] + self.before[number.get(p - 1, 0)] + self.after[number.get(p + 1, 0)] for p in places
        ]
        moves = np.exp(self.moves)
        forward, last, message = [], -1, np.array([1.0, 1.0])
        for place, odd in zip(places, odds):
            # Plain steps up to the place, then the place's own. The first token has no step into it.
            gap = place - last - 1
            if last < 0:
                message = self.start(gap)
            else:
                message = message @ self.powers[min(gap, STRETCH)]
            arrived = message @ moves if place else np.ones(2)
            message = arrived * np.exp([min(0.0, -odd), min(0.0, odd)])
            message = message / message.sum()
            forward.append(message)
            last = place
        out, ahead, following = [], np.ones(2), count
        for n in range(len(places) - 1, -1, -1):
            if n == len(places) - 1:
                ahead = self.powers[min(count - places[n] - 1, STRETCH)] @ np.ones(2)
            else:
                odd = odds[n + 1]
                ahead = moves @ (np.exp([min(0.0, -odd), min(0.0, odd)]) * ahead)
                ahead = self.powers[min(following - places[n] - 1, STRETCH)] @ ahead
            ahead = ahead / ahead.sum()
            both = forward[n] * ahead
            out.append((places[n], float(both[1] / both.sum())))
            following = places[n]
        return out[::-1]

    def start(self, gap: int) -> np.ndarray:
        """Message after `gap` plain tokens at the beginning of a text."""
        first = np.array([1.0, np.exp(self.bias)])
        return first @ self.powers[min(gap - 1, STRETCH)] if gap else np.ones(2)

    def score(self, count: int, marginals: list[tuple[int, float]]) -> float:
        return float(1 / (1 + np.exp(-(document_features(count, marginals) @ self.document))))


def document_features(count: int, marginals: list[tuple[int, float]]) -> np.ndarray:
    """One, the largest marginal, and their sum as a number and as a share of the text's `count` tokens."""
    values = [p for _, p in marginals]
    return np.array([1.0, max(values, default=0.0), np.log1p(sum(values)), np.log1p(100 * sum(values) / max(count, 1))])


def held_out(doc_id: Column) -> Column:
    """Rows that the model must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, hash of the neighbours of its first place) for each feature of a text."""
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            part = batch.slice(start, 100)
            features, tags, contexts = [], [], []
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = [b"", *tokens_of(text), b""]
                first = {}
                for token in dict.fromkeys(tokens[1:-1]):
                    for feature in word_features(token.decode("utf-8", "surrogatepass")):
                        first.setdefault(feature, token)
                at = {token: i for i, token in reversed(list(enumerate(tokens[1:-1], 1)))}
                around = {token: xxhash.xxh3_64_intdigest(tokens[i - 1] + b" " + tokens[i + 1]) >> 1 for token, i in at.items()}
                features.extend(first)
                contexts.extend(around[token] for token in first.values())
                tags.extend([toxic] * len(first))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(tags, pa.int32()), pa.array(contexts, pa.int64())], ["word", "toxic", "context"])


def _sequences(numbers: Numbers):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbers.hits(text) for text in batch.column(0).to_pylist()]
            places = pa.array([[i for i, _ in hits] for _, hits in found], pa.list_(pa.int64()))
            words = pa.array([[n for _, n in hits] for _, hits in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([n for n, _ in found], pa.int64()), places, words], ["toxic", "n", "places", "words"])

    return work


def _training_set(rows: list, reach: int) -> np.ndarray:
    """Word numbers around each vocabulary word, and of texts without any, padded by one on either side."""
    out = []
    for row in rows:
        number = dict(zip(row["places"], row["words"]))
        for i in row["places"] or ([reach] if row["n"] else []):
            out.append([number.get(i + k, 0) for k in range(-reach - 1, reach + 2)])
    return np.array(out, np.int64).reshape(-1, 2 * reach + 3)


def _fit_field(words: np.ndarray, tags: np.ndarray, size: int, rounds: int = 150, penalty: float = 1e-3) -> tuple:
    """Maximum likelihood by adaptive gradient steps; all sequences have one length, so each step runs over all of them at once."""
    weights = {"own": np.zeros(size), "before": np.zeros(size), "after": np.zeros(size), "bias": np.zeros(1), "moves": np.zeros((2, 2))}
    squares = {k: np.full_like(v, 1e-8) for k, v in weights.items()}
    count, length = tags.shape
    rows = np.arange(count)
    for _ in range(rounds):
        w = weights
        odds = w["bias"][0] + w["own"][words[:, 1:-1]] + w["before"][words[:, :-2]] + w["after"][words[:, 2:]]
        emit = np.exp(np.stack([np.minimum(0, -odds), np.minimum(0, odds)], axis=2))
        moves = np.exp(w["moves"])
        forward, backward = np.empty((count, length, 2)), np.empty((count, length, 2))
        forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            step = (forward[:, t - 1] @ moves) * emit[:, t]
            forward[:, t] = step / step.sum(axis=1, keepdims=True)
        backward[:, -1] = 0.5
        for t in range(length - 2, -1, -1):
            step = (emit[:, t + 1] * backward[:, t + 1]) @ moves.T
            backward[:, t] = step / step.sum(axis=1, keepdims=True)
        both = forward * backward
        error = tags - both[:, :, 1] / both.sum(axis=2)
        gradient = {"bias": np.array([error.sum()]), "moves": np.zeros((2, 2))}
        for name, part in (("own", words[:, 1:-1]), ("before", words[:, :-2]), ("after", words[:, 2:])):
            gradient[name] = np.bincount(part.ravel(), error.ravel(), minlength=size)
            gradient[name][0] = 0
        for t in range(1, length):
            joint = forward[:, t - 1, :, None] * moves[None] * (emit[:, t] * backward[:, t])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((count, 2, 2))
            seen[rows, tags[:, t - 1], tags[:, t]] = 1
            gradient["moves"] += (seen - joint).sum(axis=0)
        for name, value in weights.items():
            change = gradient[name] / count - penalty * value
            squares[name] += change * change
            value += 0.5 * change / np.sqrt(squares[name])
    return weights["own"], weights["before"], weights["after"], float(weights["bias"][0]), weights["moves"]


def _fit_documents(features: np.ndarray, toxic: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    weights = np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-features @ weights))
        gradient = features.T @ (toxic - p) / len(toxic) - penalty * weights
        curvature = (features * (p * (1 - p))[:, None]).T @ features / len(toxic) + penalty * np.eye(len(weights))
        weights = weights + np.linalg.solve(curvature, gradient)
    return weights


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits the model to labelled documents that aren't held out.

    `labels` has doc_id and toxic (0 or 1; other rows are ignored). Of ids with several labels the largest counts, of
    several texts of one id the one with the least hash. At most `fit_rows` ids are used; their words are counted, and their vocabulary words brought to the driver. Without labelled rows of both kinds
    the model knows no words and gives all documents one score.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = stage(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "toxicity_sample")
    # The chosen ids are no more than `fit_rows`, whatever the tables hold, and each has one text. Stored, since it is read twice.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stage(once, "toxicity_texts").select("text", "toxic")

    words = sample.mapInArrow(_contexts, "word string, toxic int, context long").distinct().groupBy("word").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("bad"), F.count(F.when(F.col("toxic") == 0, 1)).alias("good")
    )
    totals = {row["toxic"]: row["count"] for row in chosen.groupBy("toxic").count().collect()}
    many = np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - F.lit(float(many))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    telling = words.withColumn("odds", odds).filter((F.col("bad") >= LEAST_CONTEXTS) & (F.col("odds") >= LEAST_LOG_ODDS) & (F.col("odds") / spread >= LEAST_Z))
    found = telling.orderBy((F.col("odds") / spread).desc(), "word").limit(VOCABULARY).collect()
    numbers = Numbers({row["word"]: n for n, row in enumerate(found, 1)})

    rows = sample.mapInArrow(_sequences(numbers), "toxic int, n long, places array<long>, words array<int>").collect()
    size = len(found) + 1
    sequences = [_training_set([row for row in rows if row["toxic"] == tag], REACH) for tag in (0, 1)]
    words_of, tags = np.concatenate(sequences), np.zeros((sum(map(len, sequences)), 2 * REACH + 1), np.int64)
    tags[len(sequences[0]) :] = sequences[1][:, 1:-1] > 0
    blank = Model(numbers, np.zeros(size), np.zeros(size), np.zeros(size), -5.0, np.zeros((2, 2)), np.zeros(4))
    if not found:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        blank.document = np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0, 0.0])
        return blank
    model = Model(numbers, *_fit_field(words_of, tags, size), blank.document)
    features = np.array([document_features(row["n"], model.marginals(row["n"], list(zip(row["places"], row["words"])))) for row in rows])
    model.document = _fit_documents(features, np.array([row["toxic"] for row in rows]))
    return model


def _scoring(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                marginals, value = _judge(model, text)
                scores.append(value)
                bad = {i: p for i, p in marginals if p >= MARGINAL}
                counts.append(len(bad))
                places = enumerate(TOKEN.finditer(text)) if bad else ()
                spans.append([{"start": m.start(), "end": m.end(), "marginal": bad[i]} for i, m in places if i in bad])
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "toxic_tokens", "spans"])

    return work


def _judge(model: Model, text: str | None) -> tuple[list[tuple[int, float]], float]:
    count, hits = model.numbers.hits(text)
    marginals = model.marginals(count, hits) if hits else []
    return marginals, model.score(count, marginals)


def _filtering(model: Model, column: int, below: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_judge(model, text.as_py())[1] < below for text in batch.column(column)], pa.bool_()))

    return work


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), toxic_tokens, spans (start and end in code points, marginal).

    Each row is scored by its text alone. Null and empty texts have the score of a text without telling words, and no spans.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scoring(model), SCORED)


def less_toxic(docs: DataFrame, model: Model, below: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below the limit. Rows are judged where they are, without a join."""
    return docs.mapInArrow(_filtering(model, docs.columns.index("text"), below), docs.schema)
