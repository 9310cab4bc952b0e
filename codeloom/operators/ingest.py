"""Ingest: source rows to records of the knowledge table.

Files are parsed inside partitions; a file that fails is one row with its error, and never fails the job. Fingerprints of the text are
built-in column functions; only the tree needs Python.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import ngram_fingerprint
from ..parsing import structure_fingerprint, units_of
from ..parsing.outline import is_valid
from ..parsing.structure import folds
from ..schema import RECORD

_UNIT = T.StructType([f for f in RECORD if f.name != "text_fingerprint"] + [T.StructField("position", T.IntegerType()), T.StructField("error", T.StringType())])
#: The parser's depth of nesting; an environment variable of the workers may set another.
RECURSION_LIMIT = int(os.environ.get("CODELOOM_RECURSION_LIMIT", "20000"))
ERROR_LENGTH, ROWS_PER_BATCH = 80, 512


def _rows_of(file: dict, min_lines: int) -> list[tuple]:
    place = (file["repository"], file["relative_path"], file["file_extension"], file["language"])
    try:
        rows = []
        units = units_of(file["content"], file["language"], min_lines)
        shapes = folds([u.node for u in units if u.node is not None])
        for k, u in enumerate(units):
            shape = next(shapes) if u.node is not None else structure_fingerprint(u.text, file["language"])
            rows.append((*place, u.kind, u.node_type, u.symbol_name, u.qualified_name, u.parent_qualified_name, u.start_line, u.end_line, u.text, shape, k, None))
        return rows
    except Exception as e:  # one bad file is one row
        return [(*place, *[None] * 10, str(e)[:ERROR_LENGTH])]


def _units(batches: Iterator[pa.RecordBatch], min_lines: int) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION_LIMIT))
    schema = to_arrow_schema(_UNIT)
    for b in batches:
        rows: list[tuple] = []
        for file in b.to_pylist():
            rows += _rows_of(file, min_lines)
            if len(rows) >= ROWS_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def extract(sources: DataFrame, min_lines: int = 0, n: int = 2, partitions: int | None = None) -> DataFrame:
    """Source rows (repository, relative_path, file_extension, language, content) -> records, with position and error.

    Rows with an error have no kind. partitions: spread small inputs over that many tasks.
    """
    rows = sources.where("content is not null").select("repository", "relative_path", "file_extension", "language", "content")
    if partitions:
        rows = rows.repartition(partitions)
    units = rows.mapInArrow(lambda it: _units(it, min_lines), _UNIT)
    return units.withColumn("text_fingerprint", ngram_fingerprint("text", n))


def records(extracted: DataFrame) -> DataFrame:
    """The records among extracted rows, with the position that decides among equal keys."""
    return extracted.where("error is null").select(*RECORD.names, "position")


def counts(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """By repository: files, entries before and after equal keys are joined, errors, and up to three messages of them in order of path."""
    files = sources.groupBy("repository").agg(F.count_if(F.col("content").isNotNull()).alias("files"), F.count_if(F.col("error").isNotNull()).alias("bad_archives"))
    key = F.struct("relative_path", "kind", "qualified_name", "start_line", "end_line")
    units = extracted.groupBy("repository").agg(F.count_if(F.col("error").isNull()).alias("entries"), F.countDistinct(F.when(F.col("error").isNull(), key)).alias("distinct_entries"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    failed = extracted.where("error is not null").select("repository", "relative_path", "error").unionByName(sources.where("error is not null").select("repository", "relative_path", "error"))
    place = F.row_number().over(Window.partitionBy("repository").orderBy("relative_path", "error"))
    first = failed.withColumn("k_", place).where("k_ <= 3").withColumn("told_", F.concat_ws(": ", "relative_path", "error"))
    told = first.groupBy("repository").agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", "told_"))), lambda s: s["told_"]).alias("messages"))
    joined = files.join(units, "repository", "left").fillna(0).join(told, "repository", "left")
    return joined.withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def _each(function, codes: pd.Series, languages: pd.Series, failed) -> list:
    """function of each row; `failed` for a row that can't be parsed, so one bad query never fails the others."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION_LIMIT))
    out = []
    for code, language in zip(codes, languages):
        try:
            out.append(function(code, language))
        except Exception:
            out.append(failed)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def structure_fp(code: pd.Series, language: pd.Series) -> pd.Series:
    """Structure fingerprint of whole texts; NULL for NULL texts, unknown languages and what can't be parsed."""
    return pd.Series(_each(structure_fingerprint, code, language, None), dtype=object)


@F.pandas_udf(T.BooleanType())
def syntax_ok(code: pd.Series, language: pd.Series) -> pd.Series:
    """Whether a text parses without error; True for languages that aren't served."""
    return pd.Series(_each(lambda c, x: c is None or is_valid(c, x), code, language, False))
