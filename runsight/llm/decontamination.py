"""Finds benchmark items in documents, also with edits.

Items and documents are word sequences; two are alike if their edit distance is at most `edits` of the item's words. The CGK random walk
turns edit distance into Hamming distance: a walk reads a sequence word by word, writes the word it stands on, and moves on or stays
by a random bit that depends on step and word. Windows of an item's size start at every word of a document. A window and an item are
candidates if their walks agree in one of `BANDS` random samples of positions. Candidates are verified by the exact edit distance
between the item and any part of the text there.

Ahead of the walk, windows that cannot be alike are left out, without loss: an edit destroys at most three word triples of the item, so
a window around a copy holds the others.

Items of few words are no sequences that could be edited and still be told from chance: these are found where a text has all their words
in order. In scripts without spaces each sign is a word.

Documents are read once for each block of items, and nothing is shuffled. A block of items is of bounded size, and that is what is
sent to the tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDITS = 0.2
MIN_WORDS = 8
"""Shorter items are found by all their words only. Any longer one keeps a triple (see above)."""
LEAST_WORDS = 4
"""Items of fewer words stand in texts by chance: by default they are left out, and documents that hold them stay."""
ITEMS_PER_BLOCK, WORDS_PER_BLOCK = 20_000, 2_000_000
SAMPLED, BANDS = 2, 160
"""Two walks that agree in a quarter of their positions, as after edits of a fifth of the words, share a sample with probability
1 - (1 - 1/16)^160 = 0.99997; windows that start a few words off are further tries."""
WINDOWS_AT_ONCE = 5_000
WORDS_AT_ONCE = 2_000_000

_SPACES = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0)
FOUND = "doc_id long, item_id long, distance int, item_words int, start_word long, end_word long"


_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
"""Signs of scripts that put no spaces between words."""


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of characters other than ASCII punctuation and whitespace, in lower case; in scripts without spaces, of the signs."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(lambda m: f" {m.group()} " if m.group().isalnum() else " ", text)
    words = text.encode("utf-8", "surrogatepass").translate(_SPACES).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _triples(words: np.ndarray) -> np.ndarray:
    return (words[:-2] * _MIX + words[1:-1]) * _MIX + words[2:]


def _sequences(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in order."""
    keys = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(keys) else 0):
        keys = (keys ^ (keys >> np.uint64(29))) * _MIX + words[k : k + len(keys)]
    return keys


def walk(windows: np.ndarray) -> np.ndarray:
    """CGK embedding of equally long sequences (rows) into 3 times as many positions."""
    count, size = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), _PAD, np.uint64)], axis=1)
    steps = np.random.default_rng(size).integers(0, 2**63, 3 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place, row, out = np.zeros(count, np.int64), np.arange(count), np.empty((3 * size, count), np.uint64)
    for j, step in enumerate(steps):
        out[j] = word = padded[row, place]
        place += ((word * step) >> np.uint64(63)).astype(np.int64)
        np.minimum(place, size, out=place)
    return out


def samples(windows: np.ndarray) -> np.ndarray:
    """For each sequence (row) and band (column), a hash of the band and the sampled positions of its walk."""
    size = windows.shape[1]
    walked = walk(windows)
    # A walk moves on at every second step, so after twice the size it mostly stands behind the end, where all walks agree.
    places = np.random.default_rng(size + 1_000_000).integers(0, 2 * size, (BANDS, SAMPLED))
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], walked.shape[1], axis=1)
    for i in range(SAMPLED):
        keys = (keys ^ (keys >> np.uint64(29))) * _MIX + walked[places[:, i]]
    return keys.T


def nearest_part(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance between the item and any part of the text, end of such a part), the first end of those."""
    steps = np.arange(len(item) + 1)
    column, best, end = steps.copy(), len(item), 0
    for position, word in enumerate(text):
        low = np.empty_like(column)
        low[0] = 0
        low[1:] = np.minimum(column[1:] + 1, column[:-1] + (item != word))
        column = np.minimum.accumulate(low - steps) + steps
        if column[-1] < best:
            best, end = int(column[-1]), position + 1
    return best, end


@dataclass
class ItemIndex:
    """A block of items, grouped by their number of words."""

    by_size: dict[int, tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]]
    """By number of words: ids, words, samples in order, and whose samples they are."""
    triples: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    """The sizes of the items that hold the triple number i are sizes[first[i] : first[i + 1]]."""
    edits: float
    short: dict[int, tuple[np.ndarray, list[int], np.ndarray]]
    """Of the short items, by number of words: hashes of their words in order, ids, and their words."""

    @staticmethod
    def build(items: list[tuple[int, np.ndarray]], edits: float) -> ItemIndex:
        few: dict[int, list] = defaultdict(list)
        for item_id, words in items:
            if len(words) < MIN_WORDS:
                few[len(words)].append((item_id, words))
        short = {}
        for n, group in few.items():
            keys = np.array([_sequences(w, n)[0] for _, w in group], np.uint64)
            order = np.argsort(keys, kind="stable")
            short[n] = keys[order], [group[i][0] for i in order], np.stack([group[i][1] for i in order])
        items = [item for item in items if len(item[1]) >= MIN_WORDS]
        groups: dict[int, list] = defaultdict(list)
        for item_id, words in items:
            groups[len(words)].append((item_id, words))
        by_size = {}
        for n, group in sorted(groups.items()):
            keys = samples(np.stack([w for _, w in group])).ravel()
            order = np.argsort(keys, kind="stable")
            by_size[n] = [i for i, _ in group], [w for _, w in group], keys[order], order // BANDS
        held = {(int(t), len(words)) for _, words in items for t in _triples(words)}
        both = np.array(sorted(held), np.uint64).reshape(-1, 2)
        triples, first = np.unique(both[:, 0], return_index=True)
        return ItemIndex(by_size, triples, np.append(first, len(both)), both[:, 1].astype(np.int64), edits, short)

    def allowed(self, size: int) -> int:
        return int(size * self.edits + 1e-9)

    def least_triples(self, size: int) -> int:
        """A part of a text within the allowed edits of an item holds so many of the item's word triples."""
        return max(1, size - 2 - 3 * self.allowed(size))

    def starts(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size, where windows may begin a part alike to an item of that size.

        A part that begins there is at most the allowed edits longer than the item, so the triples are counted that far.
        """
        if not len(self.triples):
            return
        triples = _triples(words)
        number = np.searchsorted(self.triples, triples)
        number[number == len(self.triples)] = 0
        places = np.flatnonzero(self.triples[number] == triples)
        if not len(places):
            return
        number = number[places]
        many = self.first[number + 1] - self.first[number]
        ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        sizes, places = self.sizes[np.repeat(self.first[number], many) + ahead], np.repeat(places, many)
        for size, count in zip(*np.unique(sizes, return_counts=True)):
            if count >= self.least_triples(size):
                held = np.concatenate([[0], np.cumsum(np.bincount(places[sizes == size], minlength=len(triples)))])
                begins = np.arange(len(triples))
                ends = np.minimum(begins + size - 2 + self.allowed(size), len(triples))
                begins = begins[held[ends] - held[begins] >= self.least_triples(size)]
                if len(begins):
                    yield int(size), begins

    def search(self, docs: list[tuple[int, np.ndarray]]) -> list[tuple]:
        windows: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, (_, words) in enumerate(docs):
            if len(words) >= 3:
                for size, begins in self.starts(words):
                    windows[size].append((n, begins))
        rows = [row for doc in docs for row in self._whole(doc)]
        for size, found in windows.items():
            owners = np.concatenate([np.full(len(starts), n) for n, starts in found])
            begins = np.concatenate([starts for _, starts in found])
            near = []
            for low in range(0, len(begins), WINDOWS_AT_ONCE):
                part = slice(low, low + WINDOWS_AT_ONCE)
                window, item = self._candidates(docs, owners[part], begins[part], size)
                near.append((owners[part][window], item, begins[part][window]))
            owner, item, begin = (np.concatenate(x) for x in zip(*near))
            order = np.lexsort((begin, item, owner))
            owner, item, begin = owner[order], item[order], begin[order]
            edges = np.flatnonzero((np.diff(owner) != 0) | (np.diff(item) != 0)) + 1
            for group in np.split(np.arange(len(owner)), edges) if len(owner) else []:
                row = self._verified(docs[owner[group[0]]], size, item[group[0]], begin[group])
                if row:
                    rows.append(row)
        return rows

    def _whole(self, doc: tuple[int, np.ndarray]) -> Iterator[tuple]:
        """The short items that the document holds, each at its first place."""
        doc_id, words = doc
        for n, (known, ids, texts) in self.short.items():
            own = _sequences(words, n)
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            first: dict[int, int] = {}
            for place in np.flatnonzero(low < high).tolist():
                for item in range(low[place], high[place]):
                    if item not in first and (texts[item] == words[place : place + n]).all():
                        first[item] = place
            for item, place in first.items():
                yield doc_id, ids[item], 0, n, place, place + n

    def _candidates(self, docs, owners, begins, size) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a band, each once."""
        ids, _, known, whose = self.by_size[size]
        texts = np.full((len(owners), size), _PAD, np.uint64)
        for row, (n, start) in enumerate(zip(owners, begins)):
            words = docs[n][1][start : start + size]
            texts[row, : len(words)] = words
        own = samples(texts).ravel()
        low = np.searchsorted(known, own, "left")
        met = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == own)
        low = low[met]
        many = np.searchsorted(known, own[met], "right") - low
        ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.repeat(met // BANDS, many) * len(ids) + whose[np.repeat(low, many) + ahead]
        return np.divmod(np.unique(pairs), len(ids))

    def _verified(self, doc, size, item, begins) -> tuple | None:
        """The best of the item's places in the document, the first of equals. Overlapping windows are one place."""
        ids, texts = self.by_size[size][:2]
        doc_id, words = doc
        allowed, best, own = self.allowed(size), None, _triples(texts[item])
        edges = np.flatnonzero(np.diff(begins) > size)
        for low, high in zip([0, *(edges + 1)], [*edges, len(begins) - 1]):
            first, last = max(0, begins[low] - allowed), begins[high] + size + allowed
            if np.isin(_triples(words[first:last]), own).sum() < self.least_triples(size):
                continue
            distance, end = nearest_part(texts[item], words[first:last])
            if distance <= allowed and (best is None or distance < best[0]):
                _, length = nearest_part(texts[item][::-1], words[first : first + end][::-1])
                best = distance, int(first + end - length), int(first + end)
        return (doc_id, ids[item], best[0], size, best[1], best[2]) if best else None


def _item_blocks(items: DataFrame, least: int = 1) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' words, in blocks of bounded size. Items of fewer than `least` words are left out."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = words_of(row["text"])
        if len(words) >= least:
            if block and (len(block) == ITEMS_PER_BLOCK or size + len(words) > WORDS_PER_BLOCK):
                yield block
                block, size = [], 0
            block.append((row["item_id"], words))
            size += len(words)
    if block:
        yield block


def _in_parts(ids: list, texts: pa.Array) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The texts' words, so many texts at a time that the work for a block of items pays and memory is bounded."""
    part, size = [], 0
    for doc_id, text in zip(ids, texts):
        part.append((doc_id, words_of(text.as_py())))
        size += len(part[-1][1])
        if size > WORDS_AT_ONCE:
            yield part
            part, size = [], 0
    yield part


def _searching(index: ItemIndex):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in _in_parts(batch.column(0).to_pylist(), batch.column(1)):
                rows = index.search(docs)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])

    return work


def find_items(docs: DataFrame, items: DataFrame, edits: float = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, item_words, start_word, end_word (of the best place).

    `docs` has doc_id and text, `items` item_id and text. Null and empty texts hold nothing, and items without words are in none;
    items under MIN_WORDS words are found without edits, those under `least_words` not at all (1: all are). Rows without an id are searched like others, repeated rows give repeated results, and so do repeated items. Copies of items with
    one text are all reported. Without documents or items there are no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for block in _item_blocks(items, least_words):
        part = texts.mapInArrow(_searching(ItemIndex.build(block, edits)), FOUND)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], FOUND)


def without_items(docs: DataFrame, items: DataFrame, edits: float = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item of at least `least_words` words is found.

    Rows are tested where they are, so rows without an id and repeated rows are judged by their own texts.
    """
    for block in _item_blocks(items, least_words):
        docs = docs.mapInArrow(_filtering(ItemIndex.build(block, edits), docs.columns.index("text")), docs.schema)
    return docs


def _filtering(index: ItemIndex, column: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for docs in _in_parts(list(range(batch.num_rows)), batch.column(column)):
                keep[[row[0] for row in index.search(docs)]] = False
            yield batch.filter(pa.array(keep))

    return work
