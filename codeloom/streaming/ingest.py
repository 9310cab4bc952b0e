"""Streaming ingest, an extension: files that arrive in a folder become upserts of the knowledge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import by_extension
from ..functions.text import extension, language_of
from ..operators.ingest import extract, records
from ..operators.store import KnowledgeTable
from ..sources.files import decode_text


@F.pandas_udf("string")
def _text(content: pd.Series) -> pd.Series:
    """As in batch reads: invalid bytes dropped, line ends as line feeds."""
    return pd.Series([None if c is None else decode_text(bytes(c)) for c in content], dtype=object)


def stream_ingest(spark: SparkSession, folder: str, table: KnowledgeTable, checkpoint: str, repository: str, min_lines: int = 0, replace: bool = True) -> StreamingQuery:
    """Each micro-batch is parsed and upserted as one version; replace drops units that a newer copy of a file no longer has.

    A batch that runs again after a failure upserts the same keys, so the table ends the same.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    relative = F.regexp_replace(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root), F.lit(r"\E"))), -1), "^/+", "")
    rows = files.select(F.lit(repository).alias("repository"), relative.alias("relative_path"), _text("content").alias("content"))
    rows = rows.withColumn("file_extension", extension("relative_path")).withColumn("language", language_of("file_extension", by_extension())).where("language is not null")

    def batch(df: DataFrame, _: int) -> None:
        table.upsert(records(extract(df, min_lines)), "position", replace)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
