"""The knowledge table: one row per semantic unit of a source file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = ["repository", "relative_path", "kind", "qualified_name", "start_line", "end_line"]
ORDER = ["repository", "relative_path", "start_line", "end_line", "qualified_name"]
#: Appended to ORDER, which alone isn't total.
TOTAL_ORDER = [*ORDER, "kind", "id"]

KNOWLEDGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("repository", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("parent_qualified_name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("structure_fingerprint", T.ArrayType(T.StringType())),
        T.StructField("text_fingerprint", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)
#: What ingest produces: no id and no time stamp yet.
RECORD = T.StructType([f for f in KNOWLEDGE if f.name not in ("id", "created_at")])
FINGERPRINTS = ["structure_fingerprint", "text_fingerprint"]
#: Columns of a search result, and of a candidate without its text.
SEARCH_COLUMNS = [f.name for f in KNOWLEDGE if f.name not in ("created_at", *FINGERPRINTS)]
CANDIDATE_COLUMNS = [f.name for f in KNOWLEDGE if f.name not in ("file_extension", "created_at", "text")]
#: Columns of a retrieval result besides query_id, rank, score and containment.
PAYLOAD = [f.name for f in KNOWLEDGE if f.name not in ("file_extension", "created_at", *FINGERPRINTS)]


def check_columns(df: DataFrame) -> None:
    """Raise if a column of the table is missing; further columns are fine."""
    missing = [f.name for f in KNOWLEDGE if f.name not in df.columns]
    if missing:
        raise RuntimeError(f"the knowledge table lacks the columns {', '.join(missing)}")


def conform(df: DataFrame) -> DataFrame:
    """The table's columns by name, in order and of its types."""
    check_columns(df)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in KNOWLEDGE])
