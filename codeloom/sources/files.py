"""Sources: directories, zip archives, JSON lines and run shards; sinks for results."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import by_extension
from ..functions.text import extension, language_of
from ..operators.evaluate import calibration_best, indexed, merged
from .planned import SOURCE, ArchiveSource, TreeSource, decode_text, open_fs  # noqa: F401

def _planned(spark: SparkSession, source: type, path: str, languages: dict[str, list[str]] | None, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(languages=json.dumps(by_extension(languages)), **options).load(path)


def _served(path: str) -> bool:
    try:
        open_fs(path)
    except (ValueError, OSError):
        return False
    return True


def read_directory(spark: SparkSession, path: str, repository: str = "", languages: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """Supported files below path, by extension, letter case counted -> SOURCE rows with paths relative to it. Other files are not opened.

    Stores that only Spark reads are read as binary files, all of them. options: partitionBytes, partitionFiles.
    """
    if _served(path):
        return _planned(spark, TreeSource, path, languages, repository=repository, **options)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/")
    relative = F.regexp_replace(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root), F.lit(r"\E"))), -1), "^/+", "")
    rows = files.select(relative.alias("relative_path"), "content").withColumn("file_extension", extension("relative_path"))
    rows = rows.withColumn("language", language_of("file_extension", by_extension(languages))).where("language is not null")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[decode_text(bytes(c)) for c in b["content"]])[["relative_path", "file_extension", "language", "content"]]

    read = rows.mapInPandas(text, "relative_path string, file_extension string, language string, content string")
    return read.select(F.lit(repository).alias("repository"), *read.columns, F.lit(None).cast("string").alias("error"))


def read_archives(spark: SparkSession, path: str, languages: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """Members of the *.zip files in a directory -> SOURCE rows; the archive's stem is the repository, and a member's first path part is
    dropped if it has more. A bad archive, and a bad member, gives one row with its error and no path, so it is reported and doesn't stop the rest.

    For stores that pyarrow reads. options: partitionBytes, partitionFiles.
    """
    return _planned(spark, ArchiveSource, path, languages, **options)


REFERENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repository", "relative_path", "language", "kind", "qualified_name")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("containment", T.DoubleType())]
)
TASK = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("groundtruth", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("task_id", "repository", "file")])),
        T.StructField("retrieval_mode", T.StringType()),
        T.StructField("retrieval_query", T.StringType()),
        T.StructField("references", T.ArrayType(REFERENCE)),
    ]
)


def read_tasks(spark: SparkSession, path: str, limit: int = 0, schema: T.StructType = TASK) -> DataFrame:
    """Tasks of a JSON lines file with sample_index over its non-blank lines; limit > 0 keeps that many from the front."""
    lines = indexed(spark.read.text(path))
    if limit > 0:
        lines = lines.where(F.col("sample_index") < limit)
    return lines.select("sample_index", F.from_json("value", schema).alias("x")).select("sample_index", "x.*")


def read_shards(spark: SparkSession, directory: str, num_shards: int, schema: T.StructType | None = None, pattern: str = "per_sample.rank{}.jsonl") -> DataFrame:
    """The union of all shard files in rank order; raises if one is missing."""
    jvm = spark._jvm
    paths = [f"{directory.rstrip('/')}/{pattern.format(r)}" for r in range(num_shards)]
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(p)
    read = spark.read.schema(schema) if schema is not None else spark.read
    return merged([read.json(p) for p in paths])


def write_json(df: DataFrame, path: str, order: Iterable[str] = (), one_file: bool = False, append: bool = False) -> None:
    """JSON lines; nested arrays stay nested. one_file is for results of bounded size."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if one_file else out).write.mode("append" if append else "overwrite").json(path)


RUN_META = ["run_dir", "input_path", "output_jsonl", "num_gpus"]


def read_run_metadata(spark: SparkSession, path: str) -> dict:
    """The JSON object that describes a run, as one of its files; raises if it is missing or a field that a rerun needs is empty."""
    rows = spark.read.option("multiLine", "true").json(path).limit(1).collect()
    meta = rows[0].asDict(recursive=True) if rows else {}
    missing = [k for k in RUN_META if meta.get(k) in (None, "")]
    if missing:
        raise ValueError(f"run metadata lacks {', '.join(missing)}: {path}")
    return meta


CALIBRATION = [
    "rank", "run_dir", "prompt_builder", "decode_policy", "beam_size", "max_new_tokens", "mean_em_no_reference", "mean_es_no_reference", "empty_prediction_rate_no_reference",
    "gap_to_target_em", "gap_to_target_es",
]


def write_calibration(ranked: DataFrame, path: str) -> None:
    """Ranked runs as baseline_calibration_summary (JSON with all rows and the best) and baseline_calibration_table (CSV); columns that runs lack are empty."""
    full = ranked.select(*[F.col(c) if c in ranked.columns else F.lit(None).cast("string").alias(c) for c in CALIBRATION])
    summary = calibration_best(full).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), "rows", "best")
    write_json(summary, f"{path}/baseline_calibration_summary", one_file=True)
    write_csv(full, f"{path}/baseline_calibration_table", ["rank"])


def write_csv(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """A table of bounded size as one CSV file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def sample(df: DataFrame, n: int = 100, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same ones for the same table."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
