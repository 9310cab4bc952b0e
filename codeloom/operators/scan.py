"""Scans, search, look-ups and statistics over the knowledge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ascii_folded
from ..schema import CANDIDATE_COLUMNS, SEARCH_COLUMNS, TOTAL_ORDER


def where_equal(kb: DataFrame, language: str | Sequence[str] | None = None, repository: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows that meet every filter given; None is no filter, nor is an empty sequence of languages, but '' is one."""
    if isinstance(language, str):
        kb = kb.where(F.col("language") == language)
    elif language:
        kb = kb.where(F.col("language").isin(*language))
    if repository is not None:
        kb = kb.where(F.col("repository") == repository)
    if kind is not None:
        kb = kb.where(F.col("kind") == kind)
    return kb


def in_order(kb: DataFrame, limit: int | None = None) -> DataFrame:
    """By repository, path, lines and name; a limit of 0 or less is none."""
    kb = kb.orderBy(*TOTAL_ORDER)
    return kb.limit(limit) if limit is not None and limit > 0 else kb


def scan(kb: DataFrame, language: str | None = None, repository: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    return in_order(where_equal(kb, language, repository, kind), limit)


def candidates(kb: DataFrame, language: str | Sequence[str] | None = None, repository: str | None = None, include_text: bool = False) -> DataFrame:
    """What retrieval reads, in order; the text only if asked for."""
    rows = where_equal(kb, language, repository)
    return in_order(rows.select(*CANDIDATE_COLUMNS, *["text"] * include_text))


def fingerprint_scan(kb: DataFrame, language: str | None = None, repository: str | None = None, kind: str | None = None) -> DataFrame:
    return in_order(where_equal(kb, language, repository, kind).select(*CANDIDATE_COLUMNS))


def by_ids(kb: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows of the given ids: a list, or a DataFrame with an id column; no ids give no rows."""
    if isinstance(ids, DataFrame):
        return kb.join(ids.select("id").distinct(), "id", "left_semi")
    return kb.where(F.col("id").isin(*ids)) if ids else kb.limit(0)


def search(kb: DataFrame, keyword: str, language: str | None = None, repository: str | None = None, kind: str | None = None, shots: int | None = None) -> DataFrame:
    """Units whose text holds keyword literally, A-Z in either case; an empty keyword meets every row."""
    rows = where_equal(kb, language, repository, kind)
    rows = rows.where(contains_ascii_folded("text", keyword)) if keyword else rows.where(F.col("text").isNotNull())
    return in_order(rows, shots).select(*SEARCH_COLUMNS)


def stats(kb: DataFrame) -> DataFrame:
    """(dimension, value, n): the total, and counts by language, repository and kind, from one pass. NULL is a group."""
    dims = ["language", "repository", "kind"]
    grouped = kb.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    named: Column = F.lit("total")
    value: Column = F.lit(None).cast("string")
    for k, d in enumerate(dims):
        mine = F.col("g") == 7 - (4 >> k)
        named, value = F.when(mine, d).otherwise(named), F.when(mine, F.col(d)).otherwise(value)
    return grouped.select(named.alias("dimension"), value.alias("value"), "n")


def stats_dict(counted: DataFrame) -> dict:
    """Rows of stats() on the driver: a total and three maps."""
    out: dict = {"total": 0, "by_language": {}, "by_repository": {}, "by_kind": {}}
    for r in counted.collect():
        if r.dimension == "total":
            out["total"] = r.n
        else:
            out[f"by_{r.dimension}"][r.value] = r.n
    return out
