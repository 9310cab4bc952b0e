"""One query for each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import by_extension
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import retrieve as R
from ..operators import scan as S
from ..operators.ingest import extract
from ..operators.prompts import prompt_parts
from ..operators.quantiles import exact_medians
from ..operators.store import upsert
from ..schema import KNOWLEDGE, RECORD
from ..tables import saved
from .views import knowledge, perplexities, queries, table, turns

KEYS = ["id", "repository", "relative_path", "language", "kind", "qualified_name", "start_line", "end_line"]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places: engines add in different orders."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _joined(fp: Column | str) -> Column:
    return F.md5(F.array_join(fp, ",").cast("binary"))


def text_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.ngram_fingerprint("text").alias("fp"), X.ngram_fingerprint("text", 3).alias("fp3"))
    return d.select("doc_id", F.coalesce(F.size("fp"), F.lit(-1)).cast("long").alias("n"), _joined("fp").alias("digest"), _joined("fp3").alias("digest3"))


def search_substring(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(knowledge(spark, sf, False), "LICENSED under").select(*KEYS)


def search_limit(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(knowledge(spark, sf, False), "", language="en", kind="function", shots=25).select(*KEYS)


def scan_filtered_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan(knowledge(spark, sf, False), language="de", repository="src0", limit=20).select(*KEYS)


def candidate_scan(spark: SparkSession, sf: str) -> DataFrame:
    kb = knowledge(spark, sf).withColumn("structure_fingerprint", F.lit(None).cast("array<string>"))
    return S.candidates(kb, ["fr", "es"]).select(*KEYS, F.size("text_fingerprint").cast("long").alias("n_fp"))


def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return S.by_ids(knowledge(spark, sf, False), wanted).select(*KEYS)


def stats_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return S.stats(knowledge(spark, sf, False))


def retrieve_prefilter_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five units of highest containment of each query, among those that share anything."""
    wanted = queries(spark, sf).select("query_id", F.array_distinct("fingerprint").alias("want")).where("size(want) > 0")
    top = R.overlaps(wanted, R.Scanned(knowledge(spark, sf), "text_fingerprint"), 5).join(wanted, "query_id")
    return top.select("query_id", F.col("t.id").alias("id"), "rk", F.col("n").cast("long").alias("n"), (F.col("n") / F.size("want")).alias("containment"))


def _retrieved(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", "kind", "qualified_name", "score", "containment")


def retrieve_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(R.retrieve(queries(spark, sf), knowledge(spark, sf), shots=3, max_candidates=20))


def retrieve_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(R.retrieve(queries(spark, sf), knowledge(spark, sf), shots=3))


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "benchmark").select(F.col("item_id").alias("task_index"), F.col("text").alias("groundtruth"), X.tail_lines("text", 5).alias("retrieval_query"))
    found = R.retrieve(tasks.select(F.col("task_index").alias("query_id"), X.ngram_fingerprint("retrieval_query").alias("fingerprint")), knowledge(spark, sf), shots=3, max_candidates=20)
    return _rounded(R.hit_rate(R.augment(tasks, found, "information")))


def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents are stored; then come all that 3 divides, changed twice in one batch, the later change winning."""
    kb = knowledge(spark, sf, False)
    full = kb.select(*[F.col(f.name) if f.name in kb.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in KNOWLEDGE])
    stored = full.where("id % 2 = 0")
    batch = full.where("id % 3 = 0").select(*[c for c in RECORD.names if c != "text"], F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    batch = batch.withColumn("text", F.concat(F.lit("change "), F.col("position").cast("string")))
    out = upsert(stored, batch, "position", at="2024-01-01 00:00:00")
    return out.select("id", "qualified_name", F.when(F.col("created_at").isNotNull(), F.col("text")).alias("new_text"))


def upsert_whole_table(spark: SparkSession, sf: str) -> DataFrame:
    """All documents are stored; then all come changed twice in one batch, each third under a new key, the later change winning."""
    kb = knowledge(spark, sf, False)
    stored = kb.select(*[F.col(f.name) if f.name in kb.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in KNOWLEDGE])
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("new_"), "qualified_name")).otherwise(F.col("qualified_name"))
    batch = stored.withColumn("qualified_name", name).select(*[c for c in RECORD.names if c != "text"], F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    batch = batch.withColumn("text", F.concat(F.lit("change "), F.col("position").cast("string")))
    out = upsert(stored, batch, "position", at="2024-01-01 00:00:00")
    return out.select("id", "qualified_name", F.when(F.col("created_at").isNotNull(), F.col("text")).alias("new_text"))


def edit_similarity_ascii(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    t = turns(spark, sf, ascii_only).where("prediction_no_reference is not null")
    return t.select("sample_index", X.edit_similarity(X.first_line("groundtruth"), X.first_line("prediction_no_reference")).alias("es"))


def score_records(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    names = [f"{m}_{s}" for m in E.METRICS for s in (*E.SIDES, "improvement_abs")]
    return _rounded(E.with_scores(turns(spark, sf, ascii_only)).select("sample_index", "normalized_groundtruth", *names))


def summary_overall(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    return _rounded(E.generation_summary(E.with_scores(turns(spark, sf, ascii_only))))


def _states(records: DataFrame, fields: dict) -> DataFrame:
    """States of four shards, each from its own records."""
    return E.merged([E.summary_state(E.shard(records, 4, r), fields) for r in range(4)])


def merged_summary_overall(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    """As summary_overall, from states of four shards."""
    scored = saved(E.with_scores(turns(spark, sf, ascii_only)))
    return _rounded(E.merged_generation_summary(_states(scored, E.generation_fields())))


def merged_ppl_summary(spark: SparkSession, sf: str) -> DataFrame:
    """As ppl_summary, from states of four shards."""
    return _rounded(E.merged_summary(_states(E.ppl_improvement(perplexities(spark, sf)), E.ppl_fields()), E.ppl_fields()))


def order_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of prices, quantities and discounts of all lines, and of what lines with and without a return cost."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    kinds = {f"price_{f.lower()}": F.when(F.col("l_returnflag") == f, price) for f in ("A", "N", "R")}
    return _rounded(exact_medians(li, {"price": price, "quantity": F.col("l_quantity").cast("double"), "discount": F.col("l_discount").cast("double"), "nothing": F.lit(None).cast("double"), **kinds}))


def summary_by_repository(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    return _rounded(E.generation_by_repository(E.with_scores(turns(spark, sf, ascii_only))))


def ppl_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ppl_summary(E.ppl_improvement(perplexities(spark, sf))))


def ppl_by_repository(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ppl_by_repository(E.ppl_improvement(perplexities(spark, sf))))


def ppl_shard_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.ppl_shard_summaries(E.ppl_improvement(perplexities(spark, sf))))


def shard_summaries(spark: SparkSession, sf: str, ascii_only: bool = True) -> DataFrame:
    t = turns(spark, sf, ascii_only).withColumn("shard_rank", (F.col("sample_index") % 4).cast("int"))
    t = t.withColumn("prompt_token_count_used_no_reference", (F.col("sample_index") % 30).cast("int")).withColumn("prompt_token_count_used_with_reference", (F.col("sample_index") % 20).cast("int"))
    return _rounded(E.shard_summaries(t))


def edit_similarity_all_turns(spark: SparkSession, sf: str) -> DataFrame:
    return edit_similarity_ascii(spark, sf, ascii_only=False)


def score_records_all_turns(spark: SparkSession, sf: str) -> DataFrame:
    return score_records(spark, sf, ascii_only=False)


def summary_overall_all_turns(spark: SparkSession, sf: str) -> DataFrame:
    return summary_overall(spark, sf, ascii_only=False)


def summary_by_repository_all_turns(spark: SparkSession, sf: str) -> DataFrame:
    return summary_by_repository(spark, sf, ascii_only=False)


def shard_summaries_all_turns(spark: SparkSession, sf: str) -> DataFrame:
    return shard_summaries(spark, sf, ascii_only=False)


def merge_shards(spark: SparkSession, sf: str) -> DataFrame:
    p = perplexities(spark, sf)
    whole = E.unique_tasks(E.merged([E.shard(p, 4, r) for r in range(4)]))
    return whole.groupBy("shard_rank").agg(F.count("*").alias("n"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"))


def split_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = perplexities(spark, sf).withColumn("task_id", F.when(F.col("sample_index") % 2 == 0, F.concat(F.lit("t"), F.col("task_id"))).otherwise((F.col("sample_index") * 3).cast("string")))
    return E.split(p, 7, 3).select("sample_index", "task_id")


def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    p = perplexities(spark, sf)
    return E.remaining(p, p.where("sample_index % 3 = 0 or sample_index < 100")).select("sample_index")


def duplicate_task_check(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return E.duplicate_tasks(c.select(F.col("conv_id").alias("task_id")))


def augment_join(spark: SparkSession, sf: str) -> DataFrame:
    p = E.ppl_improvement(perplexities(spark, sf))
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_index"), F.col("o_orderstatus").alias("prompt"))
    out = E.augmented(tasks, p, "log_ppl_eval", ["task_id", "log_ppl_improvement_abs"])
    return out.select("sample_index", "prompt", F.col("log_ppl_eval.task_id").alias("task_id"), F.col("log_ppl_eval.log_ppl_improvement_abs").alias("change"))


def calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as calibration runs."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.lpad(k.cast("string"), 8, "0").alias("run_dir"),
        F.when(k % 3 == 0, "strict").when(k % 3 == 1, "plus_local8").otherwise("plus_local16").alias("prompt_builder"),
        F.when(k % 2 == 0, "greedy").otherwise("beam").alias("decode_policy"),
        F.when(k % 7 != 0, (k % 5) / F.lit(8.0)).alias("mean_em_no_reference"),
        ((k % 3) / F.lit(4.0)).alias("mean_es_no_reference"),
        ((k % 4) / F.lit(16.0)).alias("empty_prediction_rate_no_reference"),
    )


def calibration_rank(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibration_ranking(calibration_rows(spark, sf)).select("run_dir", "rank")


def reference_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as prompts and their lines as references, with quantities as token counts."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_index"), F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("tokens")
    )
    seg = li.groupBy("sample_index", "position").agg(F.max("path").alias("path"), F.max("tokens").alias("tokens"))
    seg = seg.withColumn("prompt_tokens", (F.col("sample_index") % 150).cast("int"))
    out = E.pack_references(seg, 160, 90, 20)
    return out.withColumn("used_reference_paths", F.array_join("used_reference_paths", ",")).withColumn("omitted_reference_paths", F.array_join("omitted_reference_paths", ","))


def reference_segments(spark: SparkSession, sf: str) -> DataFrame:
    kb = knowledge(spark, sf, False)
    ref = F.struct("repository", "relative_path", "kind", "qualified_name", F.concat(F.lit(" int f(int a) "), F.lit("{ "), "text").alias("text"))
    return kb.select("id", X.reference_segment(ref, F.lit(1)).alias("segment"), X.reference_path_or_name(ref).alias("path"))


def tail_line_queries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    t = X.tail_lines_with_ends("text", 2)
    return d.select("doc_id", F.md5(X.tail_lines("text", 3).cast("binary")).alias("tail"), t["line_count"].alias("n"), t["char_count"].alias("chars"))


def log_ppl(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(table(spark, sf, "embeddings").select("vec_id", E.log_ppl(F.transform("embedding", lambda x: x.cast("double"))).alias("log_ppl")))


def extension_language(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("src.v1/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".c", ".java", ".hpp", ".C", ".tar.h", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("path"))
    ext = X.extension("path")
    return p.select("p_partkey", ext.alias("ext"), X.language_of(ext, by_extension()).alias("language"))


def structure_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a tree: leaves are its lines' flags, the inner value their fold."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("x"))
    kids = F.transform("x", lambda s: X.leaf_digest(s["l_returnflag"]))
    return li.select("l_orderkey", F.substring(X.fold_structure(kids), 1, 16).alias("fp"))


def ingest_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a small C file around its id, through the parser."""
    d = table(spark, sf, "documents")
    code = F.format_string("/* document %s */\nint read_%s(int x) {\n    int a = x;\n    int b = %s;\n    return a + b;\n}\nint size_%s = %s;\n", *[F.col(c).cast("string") for c in ("doc_id", "doc_id", "n_chars", "doc_id", "n_chars")])
    src = d.select(F.col("source").alias("repository"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".c")).alias("relative_path"), F.lit(".c").alias("file_extension"), F.lit("C").alias("language"), code.alias("content"))
    return extract(src).select("repository", "relative_path", "kind", "qualified_name", "start_line", "end_line", F.size("text_fingerprint").cast("long").alias("n_fp"))


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts around every document: its text as a comment above a declaration."""
    d = table(spark, sf, "documents")
    prompt = F.concat(F.lit("/* "), F.regexp_replace("text", r"\*/", ""), F.lit(" */\nstatic int f_"), F.col("doc_id").cast("string"), F.lit("(int a)\n{\n    int b = a;\n    return "))
    out = d.select("doc_id", prompt_parts("plus_local8")(prompt).alias("p"))
    return out.select("doc_id", "p.prompt_extraction_mode_used", "p.docstring_found", "p.declaration_context_type", "p.local_context_lines_used", "p.prompt_char_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_fingerprint, search_substring, search_limit, scan_filtered_ordered, candidate_scan, lookup_ids, stats_grouping_sets, retrieve_prefilter_topk, retrieve_greedy,
        retrieve_unbounded, hit_rate, upsert_last_wins, edit_similarity_ascii, score_records, summary_overall, summary_by_repository, ppl_summary, ppl_by_repository, ppl_shard_summaries,
        shard_summaries, merge_shards, split_filter, resume_anti_join, duplicate_task_check, augment_join, calibration_rank, reference_packing, reference_segments, tail_line_queries,
        log_ppl, extension_language, structure_fold, ingest_units, prompt_context, edit_similarity_all_turns, score_records_all_turns, summary_overall_all_turns, summary_by_repository_all_turns,
        shard_summaries_all_turns, upsert_whole_table, merged_summary_overall, merged_ppl_summary, order_medians,
    )
}
