"""The engine's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, ngram_fingerprint

KINDS = ["declaration_block", "function", "method", "global", "type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge(spark: SparkSession, sf_dir: str, fingerprints: bool = True) -> DataFrame:
    """documents as a knowledge table: kinds and names by doc_id, word bigrams as fingerprints."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    out = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("repository"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("relative_path"),
        F.lit(None).cast("string").alias("file_extension"),
        F.col("lang").alias("language"),
        kind.alias("kind"),
        F.lit("document").alias("node_type"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("symbol_name"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.lit(None).cast("string").alias("parent_qualified_name"),
        F.lit(1).alias("start_line"),
        F.size(lines("text")).alias("end_line"),
        "text",
    )
    return out.withColumn("text_fingerprint", ngram_fingerprint("text")) if fingerprints else out


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as retrieval queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), ngram_fingerprint("text").alias("fingerprint"))


def turns(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """Turns of conversations as scored samples: the turn before is the groundtruth of the next; flags follow from ids.

    ascii_only leaves out the turns with other characters, as the SQL does, whose levenshtein counts bytes.
    """
    c = table(spark, sf_dir, "conversations")
    c = c.where(F.octet_length("text") == F.length("text")) if ascii_only else c
    a = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("groundtruth"))
    index = F.col("conv_id") * 100 + F.col("turn")
    j = c.join(a, ["conv_id", "turn"]).select(index.alias("sample_index"), "conv_id", "turn", "text", "groundtruth")
    n = F.col("sample_index")
    return j.select(
        n,
        n.cast("string").alias("task_id"),
        F.when(F.col("conv_id") % 7 == 0, F.lit(None)).when(F.col("conv_id") % 7 == 1, "").otherwise(F.concat(F.lit("repo"), (F.col("conv_id") % 7).cast("string"))).alias("repository"),
        "groundtruth",
        F.when(n % 11 != 0, F.col("text")).alias("prediction_no_reference"),
        F.when(n % 3 == 0, F.col("groundtruth")).when(n % 13 != 0, F.col("text")).alias("prediction_with_reference"),
        (n % 4 != 0).alias("reference_applied"),
        (n % 6).cast("int").alias("reference_candidates_considered"),
        F.element_at(F.array(*[F.lit(s) for s in ("ok", "no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "runtime_error")]), (n % 5 + 1).cast("int")).alias("comparison_status"),
        F.lit("code").alias("prompt_mode"),
        F.lit("strict").alias("prompt_builder_requested"),
        F.when(n % 9 == 0, "strict_fallback_context8").otherwise("strict").alias("prompt_extraction_mode_used"),
        F.lit("line").alias("stop_policy"),
        F.lit("beam").alias("decode_policy"),
        F.lit(4).alias("beam_size"),
        F.lit(5).alias("reference_shots_requested"),
        F.lit(64).alias("max_new_tokens_requested"),
        (n % 8 == 0).alias("empty_prediction_no_reference"),
        (n % 10 == 0).alias("empty_prediction_with_reference"),
        (n % 2 == 0).alias("docstring_found"),
        F.length("groundtruth").alias("groundtruth_token_count"),
        (n % 50).cast("int").alias("reference_token_count"),
        (n % 5).cast("int").alias("reference_used_count"),
        F.length("text").alias("prediction_token_count_no_reference"),
        (n % 40).cast("int").alias("prediction_token_count_with_reference"),
    )


def perplexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as perplexity records."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("sample_index"),
        n.cast("string").alias("task_id"),
        (n % 4).cast("int").alias("shard_rank"),
        F.when(n % 9 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("repository"),
        (n % 3 != 0).alias("reference_applied"),
        F.when(n % 17 != 0, (n % 97) / F.lit(8.0)).alias("log_ppl_no_reference"),
        F.when(n % 5 != 0, (n % 89) / F.lit(16.0)).alias("log_ppl_with_reference"),
        (n % 6).cast("int").alias("reference_candidates_considered"),
        F.element_at(F.array(*[F.lit(s) for s in ("ok", "no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "invalid_groundtruth", "runtime_error")]), (n % 6 + 1).cast("int")).alias("comparison_status"),
        F.lit(5).alias("reference_shots_requested"),
        F.lit(5).alias("prompt_tail_lines_requested"),
        *[(n % m).cast("int").alias(c) for c, m in (
            ("groundtruth_token_count", 31), ("prompt_tail_line_count_observed", 6), ("prompt_tail_token_count_full", 90), ("prompt_token_count_used_no_reference", 80),
            ("prompt_token_count_used_with_reference", 70), ("reference_token_count", 60), ("reference_used_count", 5),
        )],
    )
