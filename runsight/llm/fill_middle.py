"""Fill-in-the-middle: texts with prefix, middle and suffix in another order, and back.

A text is cut between lines into three parts. The texts of a batch lie in one byte buffer, so the work is done for all of them at
once: a scan for line ends gives the places of the cuts; where a part begins, the shift of its bytes to their new place changes, and
these changes are a difference array over the bytes; its cumulative sum is the shift of every byte, by which they are scattered into the
output. The way back finds the marks, builds the shifts in the same way, and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
"""Bytes of a mark."""
BATCH_BYTES = 8 << 20
"""Texts are taken together up to so many bytes; a longer text is taken alone."""
CHUNK = 1 << 20
"""Bytes whose shifts are held at once, so that a long text costs little more than itself."""
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Texts(NamedTuple):
    """The bytes of several texts, and where each begins and ends."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _texts(column: pa.Array) -> Texts:
    """Null texts are empty ones."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(filled) + 1, filled.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


def _column(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(kind)


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices with at most BATCH_BYTES of text, or one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, before + BATCH_BYTES, side="right")))
        yield batch.slice(first, end - first)
        first = end


def _shifts(places: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each chunk (from, to) of `size` bytes, where its bytes go: a byte's own place and the shift that holds since the last of `places`."""
    changes = np.diff(shifts, prepend=0)
    carried = 0
    for low in range(0, size, CHUNK):
        high = min(low + CHUNK, size)
        difference = np.zeros(high - low, np.int64)
        of_chunk = slice(*np.searchsorted(places, [low, high]))
        # Several parts may begin at one place, if some are empty.
        np.add.at(difference, places[of_chunk] - low, changes[of_chunk])
        difference[0] += carried
        shift = np.cumsum(difference)
        carried = shift[-1]
        yield low, high, shift + np.arange(low, high)


def _marks(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the numbers of their texts."""
    data = texts.data
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    places = places[np.isin(data[places + 1], np.frombuffer((PREFIX[1] + SUFFIX[1] + MIDDLE[1]).encode(), np.uint8))]
    # What begins in one text and ends in the next is none.
    of_text = np.searchsorted(texts.ends, places, side="right")
    inside = places + MARK <= texts.ends[of_text]
    return places[inside], of_text[inside]


def _line_cuts(texts: Texts, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of lines of each text, and the places of its two cuts."""
    data, starts, ends = texts
    lines = np.flatnonzero(data == ord("\n"))
    since, until = np.searchsorted(lines, starts), np.searchsorted(lines, ends)
    filled = ends > starts
    unended = np.zeros(len(starts), bool)
    unended[filled] = data[ends[filled] - 1] != ord("\n")
    n = until - since + unended
    line_ends = np.append(lines + 1, 0)

    def place(units: np.ndarray) -> np.ndarray:
        after = line_ends[np.minimum(since + units - 1, len(lines))]
        return np.where(units == 0, starts, np.where(units == n, ends, after))

    one, other = first % (n + 1), second % (n + 1)
    return n, place(np.minimum(one, other)), place(np.maximum(one, other))


def _put(out: np.ndarray, places: np.ndarray, mark: str) -> None:
    for at, sign in enumerate(mark.encode()):
        out[places + at] = sign


def _cut(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    texts = _texts(batch.column("text"))
    data, starts, ends = texts
    rolls = [batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
    n, low, high = _line_cuts(texts, rolls[0], rolls[1])
    plain = (ends == starts) | (rolls[2] % 100 >= rate)
    plain[_marks(texts)[1]] = True
    suffix_first = ~plain & (rolls[3] % 100 < spm)
    prefix_first = ~plain & ~suffix_first
    low, high = np.where(plain, ends, low), np.where(plain, ends, high)
    prefix, middle, suffix = low - starts, high - low, ends - high
    sizes = ends - starts + np.where(plain, 0, 3 * MARK)
    begins = np.cumsum(sizes) - sizes

    # Where each part goes, and so by how much.
    to_prefix = begins + np.where(plain, 0, np.where(suffix_first, 2 * MARK + suffix, MARK))
    to_suffix = begins + np.where(suffix_first, MARK, 2 * MARK + prefix)
    to_middle = begins + 3 * MARK + prefix + suffix
    places = np.stack([starts, low, high], axis=1).ravel()
    shifts = np.stack([to_prefix - starts, to_middle - low, to_suffix - high], axis=1).ravel()
    out = np.empty(int(sizes.sum()), np.uint8)
    for first, last, target in _shifts(places, shifts, len(data)):
        out[target] = data[first:last]
    _put(out, (to_prefix - MARK)[~plain], PREFIX)
    _put(out, (to_suffix - MARK)[~plain], SUFFIX)
    _put(out, (to_middle - MARK)[~plain], MIDDLE)

    def chars(since: np.ndarray, until: np.ndarray) -> pa.Array:
        """Code points between two places of each text; null where it stays plain."""
        counts = [np.count_nonzero((data[a:b] & 0xC0) != 0x80) for a, b in zip(since, until)]
        return pa.array(counts, pa.int64(), mask=plain)

    form = np.select([plain, prefix_first], ["plain", "psm"], "spm")
    kind = pa.string() if batch.schema.field("text").type == pa.string() else pa.large_string()
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), kind), chars(starts, low), chars(low, high), _column(out, sizes, kind)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    texts = _texts(output)
    data, starts, ends = texts
    forms = np.array(form.to_pylist(), object)
    moved = np.flatnonzero((forms == "psm") | (forms == "spm"))
    places, of_text = _marks(texts)
    since = np.searchsorted(of_text, moved)
    if (np.searchsorted(of_text, moved, side="right") - since != 3).any():
        raise ValueError("a text that isn't plain must hold three marks")
    one, two, three = (places[since + i] + MARK for i in range(3))
    first, second, middle = two - MARK - one, three - MARK - two, ends[moved] - three
    suffix_first = forms[moved] == "spm"
    prefix = np.where(suffix_first, second, first)

    sizes = ends - starts
    sizes[moved] -= 3 * MARK
    begins = np.cumsum(sizes) - sizes
    # A plain text is one part, the others are three: prefix, middle and suffix.
    to = np.stack([begins, begins + sizes, begins + sizes], axis=1)
    origin = np.stack([starts, ends, ends], axis=1)
    to[moved, 1], to[moved, 2] = begins[moved] + prefix, begins[moved] + prefix + middle
    origin[moved] = np.stack([np.where(suffix_first, two, one), three, np.where(suffix_first, one, two)], axis=1)
    out = np.empty(int(sizes.sum()), np.uint8)
    for low, high, source in _shifts(to.ravel(), (origin - to).ravel(), len(out)):
        out[low:high] = data[source]
    return _column(out, sizes, output.type)


def _cutting(rate: int, spm: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in _portions(batch, "text"):
                yield _cut(portion, rate, spm)

    return work


def _restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for portion in _portions(batch, "output"):
            restored = _restore(portion.column("output"), portion.column("form"))
            yield pa.RecordBatch.from_arrays([*portion.columns, restored], [*portion.schema.names, "restored"])


def _rolls(seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """One row per row of `docs`: doc_id, n (lines), form, prefix_chars, middle_chars (null if plain), output.

    `rate` of 100 texts are cut, and `spm` of 100 of those put the suffix before the prefix, by the hash of seed and doc_id; so repeated rows
    have one result. Texts that are null, empty or hold a mark stay plain, with the text as output (null: empty). Rows without an id
    share the hash of an empty one. Other columns are left out. A task holds a few times BATCH_BYTES, or its longest text.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_rolls(seed)).mapInArrow(_cutting(rate, spm), CUT)


def with_restored(cut: DataFrame) -> DataFrame:
    """The columns doc_id, n, form, prefix_chars, middle_chars and output of `cut`, and the texts they were, from output and form alone.

    An output that isn't plain and doesn't hold three marks is an error. A null output gives an empty text.
    """
    names = [field.split()[0] for field in CUT.split(", ")]
    return cut.select(*names).mapInArrow(_restoring, CUT + ", restored string")
