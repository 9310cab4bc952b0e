"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's result as Parquet in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, near_dedup, piece_codec, secrets, toxicity
from codeloom.llm.common import maybe_broadcast, saved, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; each row is judged by its own text. The field is fitted on labelled documents of sf_dir."""
    model = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    bad = toxicity.score_toxicity(docs, model, digest=True).where(F.col("score") >= TOXIC)
    return without(docs, bad).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked at 0.8 or more over five-word shingles.

    Of repeated rows of one id one stays. Rows without an id can't be told apart by one: they belong to no group and stay.
    """
    gone = near_dedup.near_duplicates(docs, (80, 100)).where(~F.col("kept")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = saved(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    again = maybe_broadcast(again, again.count())
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64("text", *COLUMNS)).alias("r")).select("r.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; each row is judged by its own text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with marks in place of secrets and n_chars as the text then has."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text, with whether decoding gives the text again."""
    return piece_codec.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the first and last stages; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
