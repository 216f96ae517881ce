"""Drops lines that many documents repeat, by compressed keep bitmaps.

Line hashes are counted with map-side sums, so a line in a third of all documents costs one row per task. Only the occurrences of
repeated lines go on: they are range-partitioned by (hash, document) with a secondary sort by position, the first occurrence in each
document is streamed out of the sorted ranges, and these are combined per hash. The document is part of the range key, so the most
frequent line is cut over many ranges. Text is read again only to apply the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.text import ROW_KEY, WHITESPACE, hash_pair, identified, lower_ascii, outside, runs, whole_row
from runsight.operators.skew import join_splitting_hot
from runsight.sources.staging import stage

MIN_CHARS = 40
MIN_DOCUMENTS = 5
_LINE = ("_line_a", "_line_b")


def split_lines(text: Column) -> Column:
    """Lines between newlines; null and empty texts hold one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line of at least `min_chars` code points as (ROW_KEY, doc_id, position, hashes of its key)."""
    # The outer form, since for the other the optimizer would split each text once more, to test whether there are lines.
    lines = identified(docs).select("doc_id", *ROW_KEY, F.posexplode_outer(split_lines(F.col("text"))).alias("position", "_line"))
    keys = lines.withColumn("_key", F.trim("_line", F.lit(WHITESPACE))).filter(F.length("_key") >= min_chars)
    first, second = hash_pair(lower_ascii(F.col("_key")))
    return keys.select("doc_id", *ROW_KEY, "position", first.alias(_LINE[0]), second.alias(_LINE[1]))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines that may be repeated, the repeated lines with the document that keeps them)."""
    found = _occurrences(docs, min_chars)
    often = found.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_documents)
    # The most frequent lines are dealt to several tasks each.
    often = stage(often, "line_often")
    occurrences = stage(join_splitting_hot(found, often, _LINE, "_n").drop("_n"), "line_occurrences")
    # Repeated rows become one before they are dealt out. The count above only has to be no smaller than that of documents.
    ranged = occurrences.distinct().repartitionByRange(*_LINE, "doc_id").sortWithinPartitions(*_LINE, "doc_id", "position")
    in_document = Window.partitionBy(*_LINE, "doc_id").orderBy("position", *ROW_KEY)
    firsts = ranged.withColumn("_nth", F.row_number().over(in_document)).filter("_nth = 1")
    keepers = firsts.groupBy(*_LINE).agg(F.count("doc_id").alias("documents"), F.max("doc_id").alias("keeper"))
    return occurrences, stage(keepers.filter(F.col("documents") >= min_documents), "line_keepers")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row for each distinct document that loses lines: ROW_KEY and `dropped`, its keep bitmap as runs of dropped positions.

    A line's key is the line without ASCII whitespace at both ends, with A-Z in lower case. Keys of at least `min_chars` code points
    found under at least `min_documents` ids keep only the lines of the largest id holding them, all of them. Rows without an id are
    not counted and lose such lines. Rows of one id are one document for the count, and the largest id's rows keep their lines.
    """
    occurrences, keepers = repeated_lines(docs, min_chars, min_documents)
    lost = join_splitting_hot(occurrences, keepers, _LINE, "documents").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy(*ROW_KEY).agg(F.collect_set("position").alias("_dropped")).select(*ROW_KEY, runs(F.col("_dropped")).alias("dropped"))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`doc_id`, `text` and `dropped` (null: no line is dropped) of every row."""
    return identified(docs).join(keep_bitmaps(docs, min_chars, min_documents), list(ROW_KEY), "left").drop(*ROW_KEY)


def kept_lines(text: Column, dropped: Column) -> Column:
    """The lines that stay, joined by newlines."""
    return F.array_join(outside(split_lines(text), dropped), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The same rows and columns, with repeated lines taken out of `text`.

    A null text stays null. A text that loses all its lines becomes empty. Other columns are passed on unchanged.
    """
    found = identified(docs, [whole_row(docs)]).join(keep_bitmaps(docs, min_chars, min_documents), list(ROW_KEY), "left")
    text = F.col("_all.text")
    text = F.when(F.col("dropped").isNotNull(), kept_lines(text, F.col("dropped"))).otherwise(text)
    return found.select(F.col("_all").withField("text", text).alias("_all")).select("_all.*")
