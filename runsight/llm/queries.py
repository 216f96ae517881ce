"""Registered queries of the text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_code
from runsight.llm import centroids, chat, decontamination, embedding_dedup, fill_middle, licenses, line_dedup, mixing, near_dup, pii, quality, span_dedup, toxicity
from runsight.llm.oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_dup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_tokens", spans.alias("spans")
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def of(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [of(place).alias(f"n_{kind}") for place, kind in enumerate(pii.KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("spans")).alias("spans"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    formed = chat.format_conversations(turns.union(probe))
    back = formed.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn("_loss", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=1)


def _run_lengths(found: str) -> Column:
    return F.aggregate(F.coalesce(found, F.array().cast("array<struct<start:int,length:int>>")), F.lit(0).cast("long"), lambda n, r: n + r["length"])


def span_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences, with the first of the documents that keep these."""
    found = span_dedup.changed_documents(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size(span_dedup.split_sentences(F.col("text"))).cast("long").alias("n_sentences"),
        _run_lengths("removed").alias("n_removed"),
        F.sha2(span_dedup.kept_sentences(F.col("text"), F.col("removed")), 256).alias("kept_sha256"),
        "first_doc_id",
    )


def embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def line_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.with_bitmaps(_table(spark, sf_dir, "documents"))
    lines = line_dedup.split_lines(F.col("text"))
    return found.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), _run_lengths("dropped").alias("n_dropped"), F.sha2(line_dedup.kept_lines(F.col("text"), F.col("dropped")), 256).alias("kept_sha256")
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.with_restored(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_near_dup": near_dup_minhash,
    "op2_mixing": mixture,
    "op3_toxicity": toxicity_scores,
    "op4_personal_data": personal_data,
    "op5_chat_format": chat_format,
    "op6_decontamination": decontaminate,
    "op7_span_dedup": span_dedup_digest,
    "op7_span_dedup_runs": span_dedup_digest,
    "op8_embedding_near_dup": embedding_near_dup,
    "op9_line_dedup": line_dedup_digest,
    "op10_license_scan": license_scan,
    "op11_quality": quality_scores,
    "op12_centroid_clusters": centroid_clusters,
    "op13_fill_in_middle": fill_in_middle,
}
