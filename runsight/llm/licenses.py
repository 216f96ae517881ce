"""Finds licence texts by canonical digest.

Case, punctuation, list markers and spellings that mean the same are levelled out; what is left of an entire text is hashed and looked up
among the digests of known licences. What stands ahead of a licence's own first words is levelled too: notices of holders go, however
long, and if there is nothing else but titles, these go as well. A text is a whole document, or one of its lines for one-line notices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.llm.licence_texts import BEGINNINGS, COMMON, COMMON_DIGESTS, EQUIVALENT, KNOWN, NAMED_TITLES
from runsight.llm.text import ROW_KEY, bound, identified
from runsight.operators.skew import join_salted
from runsight.sources.staging import stage

SIGNS = r"©|&copy;|\(c\)|filecopyrighttext"
"""What stands for the word in lower-case texts."""
MARKER = r"(^[^\p{L}\p{N}]*|[:;.,][^\p{L}\p{N}]*|\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*)(?:[0-9]{1,2}|[a-z])[.)]([ \t\n]+)"
"""A number or letter that begins an item of a list: behind punctuation or an empty line, wherever lines break."""
BEGINNING = r"(?s)^(.*?)[ \n](?:" + "|".join(r"[ \n]+".join(words.split(" ")) for words in BEGINNINGS) + r")(?:[ \n]|$)"
"""What stands ahead of a licence's own text, in a canonical text that begins with a line break."""
NOTICE = r"^(?:[^ ]+ ){0,8}copyright(?: |$)|^all rights reserved(?: |$)"
"""A paragraph that is a notice."""
FROM_NOTICE = r"(?:^| )copyright(?: .*)?$|^all rights reserved.*$"
TITLE = r"^(?:[^ ]+ ){0,14}licenses?(?: [^ ]+){0,14}$|^version [0-9][0-9a-z ]{0,40}$|^(?:" + "|".join(NAMED_TITLES) + ")$"
"""A paragraph that is a title: one of few words with the word licence, a version, or one of the named ones."""
TITLE_LINE = r"^(?:[^ ]+ ){0,6}license$"
"""A line that is a title of its own, also if it follows a notice without an empty line."""
ENDORSEMENT = r"neither the name of .{1,200}? nor the names of"
FEW_KNOWN = 1_000
"""With so many known digests or fewer, they are looked up where the texts lie; else the lines' digests are shuffled to them."""


def _respelled(text: Column, spellings: dict[str, str]) -> Column:
    """Whole words in other spellings. Each word gets spaces of its own for that, if there is any to replace."""

    def replaced(text: Column) -> Column:
        out = F.concat(F.lit(" "), F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
        for other, usual in spellings.items():
            out = F.replace(out, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual} "))
        found = reduce(Column.__or__, [text.contains(other) for other in spellings])
        return F.when(found, F.regexp_replace(out, " +", " ")).otherwise(text)

    return bound(text, replaced)


def _signed(text: Column) -> Column:
    held = reduce(Column.__or__, [text.contains(sign) for sign in ("©", "&copy;", "(c)", "filecopyrighttext")])
    return F.when(held, F.regexp_replace(text, SIGNS, " copyright ")).otherwise(text)


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form; those of signs only are empty. Each step is bound, so that none is computed again by what reads it."""
    out = bound(F.lower(F.coalesce(text, F.lit(""))), _signed)
    out = F.regexp_replace(F.regexp_replace(out, MARKER, "$1$2"), r"[^\p{L}\p{N}\n]+", " ")
    out = _respelled(out, {other: usual for other, usual in EQUIVALENT.items() if " " not in other})
    return F.transform(F.split(out, "\n"), lambda line: F.trim(line))


def _digest(text: Column) -> Column:
    """Digest of canonical text; where its lines break makes no difference. Null if nothing is left of it."""

    return _flat_digest(F.trim(F.regexp_replace(text, "[ \n]+", " ")))


def _flat_digest(flat: Column) -> Column:
    """Digest of canonical text on one line."""

    def renamed(flat: Column) -> Column:
        other = F.regexp_replace(flat, ENDORSEMENT, "neither the name of the copyright holder nor the names of")
        return F.trim(F.when(flat.contains("neither the name of"), other).otherwise(flat))

    flat = _respelled(flat, {other: usual for other, usual in EQUIVALENT.items() if " " in other})
    return bound(bound(flat, renamed), lambda flat: F.when(flat != "", F.sha2(flat, 256)))


def canonical_digests(lines: Column) -> Column:
    """(whole, body): digests of the entire text without notices, and of what follows titles and notices (null: there is other text ahead).

    Titles and notices are those ahead of the first words of a known licence; without such words, the whole text is taken as it is.
    """
    text = F.concat(F.lit("\n"), F.array_join(lines, "\n"))

    def split(text: Column) -> Column:
        # The long pattern only runs where one of its first words stands.
        hopeful = reduce(Column.__or__, [text.contains(words) for words in dict.fromkeys(words.split(" ")[0] for words in BEGINNINGS)])
        begun = hopeful & text.rlike(BEGINNING)
        parted = bound(F.regexp_extract(text, BEGINNING, 1), lambda head: _parted(text, head))
        # A text of nothing but notices has nothing left.
        marked = text.contains("copyright") | text.contains("all rights reserved")
        only = marked & F.forall(_paragraphs(text), lambda p: (p == "") | p.rlike(NOTICE))
        flat = F.array_join(F.filter(lines, lambda line: line != ""), " ")
        return F.when(begun, parted).otherwise(F.struct(F.when(~only, _flat_digest(flat)).alias("whole"), F.lit(None).cast("string").alias("body")))

    return bound(text, split)


def _paragraphs(text: Column) -> Column:
    apart = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(TITLE_LINE) & ~x.contains("copyright"), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x))
    return F.transform(F.split(F.array_join(apart, "\n"), "\n\n+"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))))


def _parted(text: Column, head: Column) -> Column:
    body = F.substr(text, F.length(head) + 1)
    paragraphs = _paragraphs(head)
    kept = F.transform(paragraphs, lambda p: F.when(p.rlike(NOTICE), F.regexp_replace(p, FROM_NOTICE, "")).otherwise(p))
    bare = F.forall(paragraphs, lambda p: (p == "") | p.rlike(NOTICE) | p.rlike(TITLE))
    return F.struct(_digest(F.concat(F.array_join(kept, " "), body)).alias("whole"), F.when(bare, _digest(body)).alias("body"))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence) of the given texts, by default of all in `licence_texts`. Of texts with one digest, the first name counts."""
    rows = spark.createDataFrame(list((KNOWN | COMMON if texts is None else texts).items()), "licence string, text string")
    both = rows.select("licence", canonical_digests(canonical_lines(F.col("text"))).alias("of"))
    named = both.select("licence", F.explode(F.array("of.whole", "of.body")).alias("digest")).filter("digest IS NOT NULL")
    if texts is None:
        named = named.unionByName(spark.createDataFrame(list(COMMON_DIGESTS.items()), "digest string, licence string"))
    return named.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None, few_known: int = FEW_KNOWN) -> DataFrame:
    """One row per document: doc_id, digest, licence (of the entire text, or null), notices (licences of entire lines, sorted).

    `known` has (digest, licence) with one row per digest; by default the texts in `licence_texts`. The licence is that of the text with its
    titles, else that of the text without. Null and empty texts have a null digest, no licence and no notices. Repeated rows give
    repeated results; rows without an id are scanned like others. Texts of any length are taken whole. With up to `few_known` known
    digests each row is scanned where it lies; with more, the digests of lines and texts are shuffled to them.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    listed = known.select("digest", "licence").limit(few_known + 1).collect()
    lines = docs.select("doc_id", "text").select("doc_id", F.col("text"), canonical_lines(F.col("text")).alias("_lines"))
    # The digest of a line is that of a text of this line alone. No known text is empty.
    of_lines = F.transform("_lines", lambda line: F.sha2(line, 256))
    if len(listed) <= few_known:
        return _looked_up(lines, of_lines, {row["digest"]: row["licence"] for row in listed})
    units = identified(lines, ["doc_id", of_lines.alias("_of_lines"), canonical_digests(F.col("_lines")).alias("_of")])
    units = stage(units, "licence_digests")
    by_line = known.select(F.col("digest").alias("_known"), F.col("licence").alias("_notice"))
    lined = units.select(*ROW_KEY, F.explode("_of_lines").alias("_digest"))
    notices = join_salted(lined, by_line, F.col("_digest") == F.col("_known"), hint="merge").groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set("_notice")).alias("notices"))
    by_name: Callable[[str], DataFrame] = lambda name: known.select(F.col("digest").alias(f"_k_{name}"), F.col("licence").alias(f"_l_{name}"))
    # Of equal texts there may be many: only distinct digests meet the known ones, and then their rows.
    named = units.select(F.col("_of.whole").alias("_whole"), F.col("_of.body").alias("_body")).distinct()
    named = named.join(by_name("whole"), F.col("_whole") == F.col("_k_whole"), "left").join(by_name("body"), F.col("_body") == F.col("_k_body"), "left")
    named = named.filter("_l_whole IS NOT NULL OR _l_body IS NOT NULL").select(F.col("_whole").alias("_w"), F.col("_body").alias("_b"), F.coalesce("_l_whole", "_l_body").alias("licence"))
    whole = units.join(named, (F.col("_of.whole") == F.col("_w")) & F.col("_of.body").eqNullSafe(F.col("_b")), "left")
    found = whole.select("doc_id", *ROW_KEY, F.col("_of.whole").alias("digest"), "licence").join(notices, list(ROW_KEY), "left")
    return found.select("doc_id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def _looked_up(lines: DataFrame, of_lines: Column, known: dict[str, str]) -> DataFrame:
    """The lookup as expressions of each row."""
    if not known:
        known = {"": ""}
    digests, names = F.lit(list(known)), F.lit(list(known.values()))
    name = lambda digest: F.get(names, F.array_position(digests, digest).cast("int") - 1)
    found = lines.select("doc_id", canonical_digests(F.col("_lines")).alias("_of"), F.array_intersect(of_lines, digests).alias("_met"))
    notices = F.array_sort(F.array_distinct(F.transform("_met", name)))
    return found.select("doc_id", F.col("_of.whole").alias("digest"), F.coalesce(name(F.col("_of.whole")), name(F.col("_of.body"))).alias("licence"), notices.alias("notices"))
