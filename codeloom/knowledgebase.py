"""The facade: ingest, query and retrieve over one stored knowledge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_languages
from .functions.text import ngram_fingerprint
from .operators import ingest, retrieve, scan
from .operators.store import KnowledgeTable
from .sources.files import read_archives, read_directory
from .sources.planned import list_files
from .tables import saved


class KnowledgeBase:
    """A knowledge base in a directory. Methods that read return DataFrames; nothing is gathered on the driver."""

    def __init__(self, spark: SparkSession, path: str = "knowledgebase/default", config_path: str | None = None, min_lines: int = 0, n: int = 2):
        self.spark, self.min_lines, self.n = spark, min_lines, n
        self.languages = load_languages(config_path)
        self.table = KnowledgeTable(spark, path)

    # ingest

    def sources(self, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
        """(repository, relative_path, content) tuples as source rows."""
        from .config import by_extension
        from .functions.text import extension, language_of

        df = self.spark.createDataFrame(list(rows), "repository string, relative_path string, content string")
        df = df.withColumn("file_extension", extension("relative_path"))
        return df.withColumn("language", language_of("file_extension", by_extension(self.languages))).withColumn("error", F.lit(None).cast("string"))

    def ingest(self, sources: DataFrame, partitions: int | None = None) -> DataFrame:
        """Records of source rows, not stored yet. Rows of unknown languages give none."""
        return ingest.extract(sources.where("language is not null"), self.min_lines, self.n, partitions)

    def update(self, extracted: DataFrame, replace: bool = False) -> str | None:
        return self.table.upsert(ingest.records(extracted), "position", replace)

    def update_from_sources(self, sources: DataFrame, replace: bool = False, overwrite: bool = False, workers: int | None = None) -> DataFrame:
        """Ingest and store; the counts by repository, with the first three error messages.

        overwrite: the base holds just these units afterwards, with new ids. workers: tasks that parse (default: as the sources are dealt).
        """
        extracted = saved(self.ingest(sources, workers))
        if overwrite:
            self.table.clear()
        self.update(extracted, replace)
        return ingest.counts(sources, extracted)

    def import_directory(self, path: str, repository: str = "", **how) -> DataFrame:
        return self.update_from_sources(read_directory(self.spark, path, repository, self.languages), **how)

    def import_archives(self, path: str, **how) -> DataFrame:
        return self.update_from_sources(read_archives(self.spark, path, self.languages), **how)

    def get_files_by_extension(self, directory: str, extensions: Sequence[str]) -> list[str]:
        """Paths of the files below a directory that end in one of the extensions, in order; no file is opened."""
        return list_files(directory, extensions)

    # query

    def load(self) -> DataFrame:
        return self.table.load()

    def search(self, query: str, language: str | None = None, repository: str | None = None, kind: str | None = None, shots: int | None = None) -> DataFrame:
        return self.table.search(query, language, repository, kind, shots)

    def scan(self, language: str | None = None, repository: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        return scan.scan(self.load(), language, repository, kind, limit)

    def by_ids(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        return scan.by_ids(self.load(), ids)

    def stats(self) -> dict:
        return scan.stats_dict(self.table.stats())

    # retrieve

    def knowledge_retrieve(self, queries: DataFrame | Sequence[str], language: str, shots: int = 5, repository: str | None = None, limit: int = -1, max_candidates: int = -1) -> DataFrame:
        """By structure. queries: (query_id, text), or a list of texts. Queries that can't be parsed have no rows; an empty text still has a root."""
        q = self._queries(queries).select("query_id", ingest.structure_fp(F.col("text"), F.lit(language)).alias("fingerprint")).where("fingerprint is not null")
        return retrieve.retrieve(q, self.table.index("structure_fingerprint", language or None, repository or None), "structure_fingerprint", shots, limit=limit, max_candidates=max_candidates)

    def information_retrieve(self, queries: DataFrame | Sequence[str], language: str | None = None, shots: int = 5, repository: str | None = None, limit: int = -1, max_candidates: int = -1) -> DataFrame:
        """By words. Queries without words have no rows."""
        q = self._queries(queries).select("query_id", ngram_fingerprint("text", self.n).alias("fingerprint")).where("fingerprint is not null")
        return retrieve.retrieve(q, self.table.index("text_fingerprint", language or None, repository or None), "text_fingerprint", shots, limit=limit, max_candidates=max_candidates)

    def _queries(self, queries: DataFrame | Sequence[str]) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        return self.spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, text string")
