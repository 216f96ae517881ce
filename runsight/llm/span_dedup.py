"""Removes sentences that repeat in longer spans elsewhere.

Runs of consecutive sentences are hashed where they stand, by array expressions: the shortest ones with enough words from each sentence
on, and up to each sentence. Whatever longer run repeats, these cover all of it. A first pass counts hashes with map-side sums; only
occurrences of repeated ones go on. The first occurrence of each span stays, and the sentences that any other occurrence covers are
removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.llm.text import ROW_KEY, bound, identified, lower_ascii, outside, runs, whole_row
from runsight.sources.staging import stage

SENTENCE = r"[^.!?\n]*[.!?\n][.!?\n \t\x0B\f\r]*|[^.!?\n]+"
"""A sentence with what separates it from the next; so the sentences of a text make up the text."""
SENTENCES, MIN_WORDS = 2, 12
LONG_SENTENCE = 30
_SPAN = ("_span_a", "_span_b")


def split_sentences(text: Column) -> Column:
    """The sentences of a text, none for null and empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 0)


def _hashed_sentences(text: Column) -> Column:
    """Two hashes and the number of words of each sentence."""
    plain = split_sentences(F.regexp_replace(lower_ascii(text), r"[ \t\x0B\f\r]+", " "))
    words = lambda s: F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    known = lambda s: F.struct(F.xxhash64(F.lit(0), s).alias("a"), F.xxhash64(F.lit(1), s).alias("b"), words(s).alias("w"))
    return F.transform(F.transform(plain, lambda s: F.trim(s, F.lit(" \n"))), known)


def _spans(hashed: Column, length: int, min_words: int) -> Column:
    """(position, length, two hashes) of each run of `length` sentences with enough words."""

    def span(i: Column) -> Column:
        parts = [F.get(hashed, i + k) for k in range(length)]
        words = sum((p["w"] for p in parts[1:]), parts[0]["w"])
        hashes = [F.xxhash64(F.lit(length), *[p[x] for p in parts]).alias(x) for x in "ab"]
        return F.when(words >= min_words, F.struct(i.alias("position"), F.lit(length).alias("length"), *hashes))

    # An index past the end yields null, so a text without sentences needs no case of its own.
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashed) - 1, F.lit(0))), span), lambda x: x.isNotNull())


def _grown(hashed: Column, sentences: int, min_words: int) -> Column:
    """(position, length, two hashes) of the shortest runs of `sentences` or more with enough words: from each sentence on, and up to each.

    In a run with enough words, what follows a sentence either has enough words too, so the shortest run from there is inside, or lies in
    the shortest run up to the end. So these runs cover every longer one, and none goes beyond it.
    """
    # Only the first sentence of a text can be without words.
    reach = max(sentences, min_words + 1)
    enough = lambda n, w: (n >= sentences) & (w >= min_words)
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))

    def shortest(parts: Column) -> Column:
        return F.aggregate(parts, none, lambda run, p: F.when(enough(run["n"], run["w"]), run).otherwise(F.struct((run["n"] + 1).alias("n"), (run["w"] + p["w"]).alias("w"))))

    def span(position: Column, length: Column) -> Column:
        parts = F.slice(hashed, position + 1, length)
        hashes = [F.xxhash64(length, F.transform(parts, lambda p: p[x])).alias(x) for x in "ab"]
        return F.struct(position.cast("int").alias("position"), length.cast("int").alias("length"), *hashes)

    def few(first: Column) -> Column:
        """Whether the run of `sentences` from there has too few words or doesn't exist, so that a longer one is looked for."""
        words = sum((F.get(hashed, first + k)["w"] for k in range(1, sentences)), F.get(hashed, first)["w"])
        return (first < 0) | F.coalesce(words < min_words, F.lit(True))

    def onward(i: Column) -> Column:
        run = bound(shortest(F.slice(hashed, i + 1, reach)), lambda run: F.when(enough(run["n"], run["w"]), span(i, run["n"])))
        return F.when(few(i), run).otherwise(span(i, F.lit(sentences)))

    def upto(i: Column) -> Column:
        low = F.greatest(i + 1 - reach, F.lit(0))
        # Those that have enough words without sentence i; the others are the shortest from their first sentence on as well.
        new = lambda run: enough(run["n"], run["w"]) & enough(run["n"] - 1, run["w"] - F.get(hashed, i)["w"])
        run = bound(shortest(F.reverse(F.slice(hashed, low + 1, i - low + 1))), lambda run: F.when(new(run), span(i + 1 - run["n"], run["n"])))
        return F.when((i >= sentences) & few(i + 1 - sentences), run)

    places = F.sequence(F.lit(0), F.greatest(F.size(hashed) - 1, F.lit(0)))
    return F.filter(F.concat(F.transform(places, onward), F.transform(places, upto)), lambda x: x.isNotNull())


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE, grow: bool = True) -> DataFrame:
    """Each occurrence of a span but the first: ROW_KEY, position, length, first_doc_id.

    Spans are equal if their sentences are, with A-Z in lower case, runs of whitespace as one space, and none at the ends. A span is a run of
    `sentences` or more sentences (without `grow`, exactly so many) with at least `min_words` words, or one sentence with at least
    `long_sentence` words. Of the runs, those are given that cover all others. The first
    occurrence is that of the smallest doc_id, then of the smallest position; rows without an id come first. Repeated rows are one occurrence, so each of them keeps its text.
    """
    several = _grown if grow else _spans
    spans = bound(_hashed_sentences(F.col("text")), lambda known: F.concat(several(known, sentences, min_words), _spans(known, 1, long_sentence)))
    # The outer form, since for the other the optimizer would compute the spans once more, to test whether there are any.
    found = identified(docs).select("doc_id", *ROW_KEY, F.explode_outer(spans).alias("_s")).filter("_s IS NOT NULL")
    found = found.select("doc_id", *ROW_KEY, "_s.position", "_s.length", F.col("_s.a").alias(_SPAN[0]), F.col("_s.b").alias(_SPAN[1]))
    # Stored, so that texts are split and hashed once: it is read for the counts and for the occurrences.
    found = stage(found, "spans")
    often = found.groupBy(*_SPAN).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # Stored, so that the join below has nothing but a shuffle on either side and a frequent span can be split.
    often = stage(often, "span_often")
    occurrences = stage(found.join(often, list(_SPAN)), "span_occurrences")
    place = F.struct("doc_id", "position", *ROW_KEY)
    firsts = stage(occurrences.groupBy(*_SPAN).agg(F.min(place).alias("_first")), "span_firsts")
    later = occurrences.join(firsts, list(_SPAN)).filter(~place.eqNullSafe(F.col("_first")))
    return later.select(*ROW_KEY, "position", "length", F.col("_first.doc_id").alias("first_doc_id"))


def removed_sentences(docs: DataFrame, **limits: int | bool) -> DataFrame:
    """One row for each distinct document that loses sentences: ROW_KEY, `removed` (runs of positions), `first_doc_id` (the smallest)."""
    covered = repeated_spans(docs, **limits).select(*ROW_KEY, "first_doc_id", F.explode(F.sequence("position", F.col("position") + F.col("length") - 1)).alias("_at"))
    return covered.groupBy(*ROW_KEY).agg(F.collect_set("_at").alias("_at"), F.min("first_doc_id").alias("first_doc_id")).select(*ROW_KEY, runs(F.col("_at")).alias("removed"), "first_doc_id")


def kept_sentences(text: Column, removed: Column) -> Column:
    return F.array_join(outside(split_sentences(text), removed), "")


def dedup_spans(docs: DataFrame, **limits: int | bool) -> DataFrame:
    """The same rows and columns, with repeated spans taken out of `text`. A null text stays null; one that loses everything is empty."""
    found = identified(docs, [whole_row(docs)]).join(removed_sentences(docs, **limits), list(ROW_KEY), "left")
    text = F.col("_all.text")
    text = F.when(F.col("removed").isNotNull(), kept_sentences(text, F.col("removed"))).otherwise(text)
    return found.select(F.col("_all").withField("text", text).alias("_all")).select("_all.*")


def changed_documents(docs: DataFrame, **limits: int | bool) -> DataFrame:
    """`doc_id`, `text`, `removed` and `first_doc_id` of the rows that lose sentences."""
    return identified(docs).join(removed_sentences(docs, **limits), list(ROW_KEY)).drop(*ROW_KEY)
