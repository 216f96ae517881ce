from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from runsight.llm import fill_middle
from runsight.llm.fill_middle import fill_in_middle, with_restored

SCHEMA = "doc_id long, text string"
SIGNS = ["a", "b", "\n", "é", "<", "P", "S", "M", ">", "<P>", "漢", "𝄞", " "]


def plainly(doc_id, text, rate=100, spm=50):
    text, shown = text or "", "" if doc_id is None else doc_id
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{shown}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_texts(count, seed=5):
    dice = random.Random(seed)
    odd = [None, "", "\n", "\n\n", "<", "<P", "P>", "S>", "a<P>b", "one line", "x\r\ny\x00 z", "<\nS>"]
    return odd + ["".join(dice.choices(SIGNS, [5, 5, 4, 2, 2, 1, 1, 1, 2, 0.1, 1, 1, 1], k=dice.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("chunk, at_once", [(7, 50), (1 << 20, 8 << 20)])
@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 50)])
def test_batches_equal_the_plain_version(chunk, at_once, rate, spm, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", at_once)
    texts = some_texts(300)
    digests = [hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in range(len(texts))]
    rolls = [pa.array([int(d[8 * k : 8 * k + 8], 16) for d in digests]) for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), *rolls], ["doc_id", "text", "_h0", "_h1", "_h2", "_h3"])
    found = list(fill_middle._cutting(rate, spm)(iter([batch])))
    assert (len(found) > 10) == (at_once == 50)
    rows = [row for part in found for row in part.to_pylist()]
    assert [tuple(row.values())[1:] for row in rows] == [plainly(i, text, rate, spm) for i, text in enumerate(texts)]
    back = [row["restored"] for part in fill_middle._restoring(iter(found)) for row in part.to_pylist()]
    assert back == [text or "" for text in texts]


def test_rows_equal_the_plain_version_and_come_back(spark):
    texts = some_texts(200, seed=8)
    rows = [(i % 150 if i % 40 else None, text) for i, text in enumerate(texts)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", F.lit("x").alias("form"), F.lit(1).alias("_h0"), F.lit(2).alias("output"))
    found = with_restored(fill_in_middle(docs)).collect()
    expected = sorted(((doc_id, *plainly(doc_id, text), text or "") for doc_id, text in rows), key=repr)
    assert sorted((tuple(row) for row in found), key=repr) == expected


def test_long_text_and_empty_table(spark):
    line = "word é\n"
    docs = spark.range(1).select(F.lit(3).cast("long").alias("doc_id"), F.repeat(F.lit(line), 700_000).alias("text"))
    row = with_restored(fill_in_middle(docs)).select("n", "form", "prefix_chars", "middle_chars", F.sha2("restored", 256).alias("h"), F.length("output").alias("size")).first()
    text = line * 700_000
    _, form, prefix, middle, output = plainly(3, text)
    assert tuple(row) == (700_000, form, prefix, middle, hashlib.sha256(text.encode()).hexdigest(), len(output))
    assert with_restored(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []


def test_marks_that_are_missing_are_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError, match="three marks"):
        fill_middle._restore(pa.array(["<P>a<S>b"]), pa.array(["psm"]))
    assert fill_middle._restore(pa.array(["<P>a<S>b", None]), pa.array(["plain", "plain"])).to_pylist() == ["<P>a<S>b", ""]


def test_shares_follow_rate_and_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    forms = {row["form"]: row["count"] for row in fill_in_middle(docs, rate=50, spm=25, seed=1).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 500) < 120 and abs(forms["psm"] - 1500) < 150
