"""A PySpark-native engine for corpora of source code and text."""

from importlib import import_module

_HOME = {
    "config": ["LANGUAGES", "by_extension", "load_languages"],
    "functions.text": ["edit_similarity", "fingerprint_hash", "ngram_fingerprint", "ngrams", "tail_lines"],
    "knowledgebase": ["KnowledgeBase"],
    "operators.evaluate": ["generation_by_repository", "generation_summary", "merged_generation_summary", "ppl_by_repository", "ppl_summary", "summary_state", "with_scores"],
    "operators.ingest": ["extract", "structure_fp", "syntax_ok"],
    "operators.quantiles": ["exact_medians"],
    "operators.retrieve": ["augment", "hit_rate", "references", "retrieve"],
    "operators.scan": ["by_ids", "scan", "search", "stats"],
    "operators.store": ["KnowledgeTable", "upsert"],
    "parsing": ["parse", "structure_fingerprint", "units_of"],
    "schema": ["KNOWLEDGE", "check_columns"],
    "sources.files": ["read_archives", "read_directory", "read_shards", "read_tasks", "write_json"],
    "sources.shards": ["ShardLog", "remaining_by_filter"],
}
_AT = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_AT)


def __getattr__(name: str):
    """Public names, imported when first used: Python workers load only what their function needs."""
    if name in _AT:
        return getattr(import_module(f"codeloom.{_AT[name]}"), name)
    raise AttributeError(name)
