"""Queries over made sources, files and runs, each with its SQL in more_oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import by_extension
from ..functions import text as X
from ..knowledgebase import KnowledgeBase
from ..operators import evaluate as E
from ..operators import retrieve as R
from ..operators import scan as S
from ..operators.ingest import counts, extract, structure_fp, syntax_ok
from ..operators.prompts import SCHEMA, build, stop_reason
from ..sources import files as files_
from ..sources.shards import ShardLog, remaining_by_filter
from .queries import KEYS, _joined, _retrieved, _rounded
from .templates import FILES, PROMPTS, TREES
from .views import knowledge, perplexities, queries, table, turns


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one where the session is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(at or tempfile.mkdtemp(prefix='codeloom-')).rstrip('/')}/{uuid.uuid4().hex}"


def pick(values: list, by: Column) -> Column:
    """One of a few literals by a row's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def made(values: list[str], by: Column) -> Column:
    return F.replace(pick(values, by), F.lit("~"), by.cast("string"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A small file for every document, one of several kinds."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.col("source").alias("repository"), i, pick([f[1] for f in FILES], i).alias("file_extension"), pick([f[0] for f in FILES], i).alias("language"), made([f[2] for f in FILES], i).alias("content"))
    return d.select("repository", F.concat(F.lit("d"), i.cast("string"), F.col("file_extension")).alias("relative_path"), "file_extension", "language", "content", F.lit(None).cast("string").alias("error"))


def parse_units(spark: SparkSession, sf: str) -> DataFrame:
    """Types, methods, templates, namespaces, macros, Java and recovered declarations."""
    return extract(sources(spark, sf)).select("repository", "relative_path", "language", "kind", "qualified_name", "start_line", "end_line")


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = sources(spark, sf)
    return counts(s, extract(s)).drop("messages")


def facade_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest, upsert, ids and search through the facade."""
    kb = KnowledgeBase(spark, scratch(spark))
    kb.update_from_sources(sources(spark, sf))
    return kb.search("A HOLDER", language="Java").select("repository", "relative_path", "kind", "qualified_name", "start_line", "end_line", "symbol_name")


def facade_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a base that got the same files twice: equal keys stay one row."""
    kb = KnowledgeBase(spark, scratch(spark))
    kb.update(kb.ingest(sources(spark, sf)))
    kb.update(kb.ingest(sources(spark, sf)))
    return S.stats(kb.load())


def _trees(ids: Column) -> tuple[Column, Column]:
    return made([t[1] for t in TREES], ids), pick([t[0] for t in TREES], ids)


def structure_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    code, language = _trees(F.col("doc_id"))
    d = table(spark, sf, "documents").select("doc_id", structure_fp(code, language).alias("fp"))
    return d.select("doc_id", F.size("fp").cast("long").alias("n"), _joined("fp").alias("digest"))


def knowledge_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval by structure: documents as small sources, benchmark items as queries."""
    code, language = _trees(F.col("id"))
    kb = knowledge(spark, sf, False).withColumn("structure_fingerprint", structure_fp(code, language))
    asked, theirs = _trees(F.col("item_id"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), structure_fp(asked, theirs).alias("fingerprint"))
    return _retrieved(R.retrieve(q, kb, "structure_fingerprint", shots=3, max_candidates=20))


def syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    code = made(["int f_~(int a) { return a; }", "int f_~( { return 0; }", "class A~ { void f() {} }", "struct S~ { int x; };", "(", "int x~ = {1, 2"], i)
    language = pick(["C", "C", "Java", "C", "Perl", "C"], i)
    return table(spark, sf, "documents").select("doc_id", syntax_ok(code, language).alias("ok"))


def fingerprint_scan(spark: SparkSession, sf: str) -> DataFrame:
    kb = knowledge(spark, sf).withColumn("structure_fingerprint", F.lit(None).cast("array<string>"))
    return S.fingerprint_scan(kb, language="de", kind="method").select(*KEYS, F.size("text_fingerprint").cast("long").alias("n_fp"))


def set_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, residual and ordered names over the lines of each order."""
    li = table(spark, sf, "lineitem")
    part = F.col("l_suppkey").cast("string")
    by = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 3, part))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") >= 2, part))).alias("r"),
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_returnflag"))).alias("b"),
    )
    names = X.ordered_names([F.coalesce("a", F.lit("")), F.lit(""), F.coalesce("b", F.lit("")), F.lit("A")])
    return by.select("l_orderkey", F.round(X.coverage("c", "r"), 9).alias("coverage"), F.array_join(F.array_sort(X.residual("c", "r")), ",").alias("residual"), names.alias("names"))


def json_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    numbers = F.concat(F.lit("[1844674407370955"), F.lpad((k % 1600).cast("string"), 4, "0"), F.lit(", "), k.cast("string"), F.when(k % 7 == 0, "").otherwise("]"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.from_json_fingerprint(numbers), ",").alias("fp"))


def comparison_statuses(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    error = F.when(n % 17 == 0, "failed")
    return table(spark, sf, "events").select("event_id", E.comparison_status(n % 5, n % 7 - 1, n % 11 != 0, n % 13 != 0, error).alias("status"))


def stop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", (n % 65).alias("generated_token_count"), F.lit(60).alias("max_new_tokens_requested"), (n % 3 == 0).alias("saw_newline"), (n % 5 == 0).alias("saw_end"))
    return e.select("event_id", stop_reason().alias("reason"))


def locations(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge(spark, sf, False).select("id", X.location("relative_path", "start_line", "end_line").alias("location"))


def prompt_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of made prompts: comments, declarations, types, local lines, empty ones."""
    i = F.col("doc_id")

    @F.pandas_udf(SCHEMA)
    def parts(prompt, builder):
        import pandas as pd

        return pd.DataFrame([build(p, b) for p, b in zip(prompt, builder)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    d = table(spark, sf, "documents").select("doc_id", parts(made([p[1] for p in PROMPTS], i), pick([p[0] for p in PROMPTS], i)).alias("p"))
    return d.select(
        "doc_id", F.md5(F.col("p.prompt_text").cast("binary")).alias("digest"), "p.prompt_extraction_mode_used", "p.docstring_found", "p.declaration_context_type", "p.local_context_lines_used", "p.prompt_char_count"
    )


def score_join(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf, True)
    return _rounded(E.score_join(t.drop("groundtruth"), t.select("sample_index", "groundtruth")).select("sample_index", "normalized_groundtruth", *[f"{m}_{s}" for m in E.METRICS for s in (*E.SIDES, "improvement_abs")]))


def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Shards that are written in two goes, the second after one that was killed before its commit; merged, checked, sorted and read again line by line."""
    at, records = scratch(spark), perplexities(spark, sf)
    for r in range(4):
        log, mine = ShardLog(spark, at, r), E.shard(records, 4, r)
        log.append(mine.where("sample_index % 8 < 4"))
        mine.where("sample_index % 8 > 5").write.json(f"{log.path}/part000001_killed")
        log.append(remaining_by_filter(mine, log.read(records.schema)))
    whole = E.unique_tasks(E.merged([ShardLog(spark, at, r).read(records.schema) for r in range(4)]))
    files_.write_json(whole, f"{at}/merged", ["sample_index"])
    lines = E.indexed(spark.read.text(f"{at}/merged"))
    told = F.from_json("value", T.StructType([T.StructField("sample_index", T.LongType()), T.StructField("log_ppl_no_reference", T.DoubleType())]))
    return lines.select(F.col("sample_index").alias("line"), told.alias("x")).select("line", F.col("x.sample_index").alias("sample_index"), F.col("x.log_ppl_no_reference").alias("log_ppl"))


def task_files(spark: SparkSession, sf: str) -> DataFrame:
    """Augmented tasks written as JSON lines, in order over several files, and read again, up to a limit."""
    at = scratch(spark)
    ref = F.struct("source", F.lit("a.c").alias("relative_path"), F.lit(0.5).alias("score"))
    tasks = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("groundtruth"), F.lit("information").alias("retrieval_mode"), F.array(ref).alias("references"))
    files_.write_json(tasks, at, ["doc_id"])
    read = files_.read_tasks(spark, at, 300)
    return read.select("sample_index", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "groundtruth", "retrieval_mode", F.col("references")[0]["relative_path"].alias("path"), F.col("references")[0]["score"].alias("score"))


def resume_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    """As resume_anti_join, with a Bloom filter of the finished ids."""
    p = perplexities(spark, sf)
    return remaining_by_filter(p, p.where("sample_index % 3 = 0 or sample_index < 100")).select("sample_index")


def first_references(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    tasks = li.select("l_orderkey", F.when(F.col("l_orderkey") % 9 != 0, F.transform("x", lambda s: s["l_partkey"])).alias("references"))
    return E.first_references(tasks, 2).select("l_orderkey", F.size("references").cast("long").alias("n"), F.array_join("references", ",").alias("parts"))


def calibration_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked runs written as JSON and CSV: the table as read again, with the best run of the summary beside it."""
    from .queries import calibration_rows

    at = scratch(spark)
    files_.write_calibration(E.calibration_ranking(calibration_rows(spark, sf)), at)
    best = spark.read.json(f"{at}/baseline_calibration_summary").select(F.col("best.run.run_dir").alias("best"), F.size("rows").alias("runs"))
    told = spark.read.option("header", "true").csv(f"{at}/baseline_calibration_table")
    return told.select("run_dir", F.col("rank").cast("int").alias("rank"), "prompt_builder").join(F.broadcast(best))


def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A run's description of several lines, written for the largest region and read again."""
    at = scratch(spark)
    r = table(spark, sf, "region").orderBy(F.desc("r_regionkey")).limit(1)
    text = F.concat(F.lit('{\n "run_dir": "runs/'), F.col("r_regionkey").cast("string"), F.lit('",\n "input_path": "in.jsonl",\n "output_jsonl": "out.jsonl",\n "num_gpus": 4\n}\n'))
    r.select(text.alias("value")).coalesce(1).write.text(at)
    meta = files_.read_run_metadata(spark, at)
    return spark.createDataFrame([tuple(meta[k] for k in files_.RUN_META)], "run_dir string, input_path string, output_jsonl string, num_gpus long")


def strict_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of JSON records by their JSON type: strings that look like numbers don't count, nor do fractions as integers."""
    n = F.col("event_id").cast("string")
    value = F.element_at(F.array(n, F.concat(n, F.lit(".5")), F.concat(F.lit('"'), n, F.lit('"')), F.lit("true"), F.lit("null"), F.lit("[1]")), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"x": '), value, F.lit("}")).alias("j"))
    return e.select("event_id", X.json_float("j", "x").alias("as_float"), X.json_int("j", "x").alias("as_int"))


def strict_means(spark: SparkSession, sf: str) -> DataFrame:
    s = strict_numbers(spark, sf)
    return _rounded(s.agg(F.avg("as_int").alias("mean_int"), F.count("as_int").alias("ints"), F.avg("as_float").alias("mean_float"), F.count("as_float").alias("floats")))


def unsupported_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without words or of unknown languages give no rows; an empty text still has a root, which is backfilled."""
    kb = knowledge(spark, sf, False).withColumn("structure_fingerprint", structure_fp(F.lit("int x;"), F.lit("C"))).withColumn("text_fingerprint", X.ngram_fingerprint("text"))
    q = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), made(["", " .,; ", "int a~;"], F.col("n_nationkey")).alias("text"))
    by_text = R.retrieve(q.select("query_id", X.ngram_fingerprint("text").alias("fingerprint")).where("fingerprint is not null"), kb, shots=2, max_candidates=5)
    by_tree = R.retrieve(q.select("query_id", structure_fp("text", F.lit("C")).alias("fingerprint")).where("fingerprint is not null and query_id % 3 = 0"), kb, "structure_fingerprint", shots=2, max_candidates=5)
    unknown = R.retrieve(q.select("query_id", structure_fp("text", F.lit("Perl")).alias("fingerprint")).where("fingerprint is not null"), kb, "structure_fingerprint", shots=2, max_candidates=5)
    told = lambda df, how: df.select("query_id", F.lit(how).alias("how"), "rank", (F.col("score") > 0).alias("scored"))
    return told(by_text, "text").unionByName(told(by_tree, "structure")).unionByName(told(unknown, "unknown"))


def left_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as texts of references (lines, by quantity), a prompt and a groundtruth, in tokens of four characters; the last 40 are kept."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("length"))
    by = li.groupBy(F.col("l_orderkey").alias("sample_index")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "length"))), lambda s: F.struct(F.concat(F.lit("p"), s["l_linenumber"].cast("string")).alias("path"), s["length"].alias("length"))).alias("references")
    )
    total = F.aggregate("references", F.lit(0), lambda n, r: n + r["length"]) + F.col("prompt_length") + F.col("sample_index") % 23
    by = by.withColumn("prompt_length", (F.col("sample_index") % 60).cast("int")).withColumn("total", total.cast("int"))
    tokens = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / 4) - 1, F.lit(0)).cast("int")), lambda i: F.struct((i * 4).alias("start"), F.least(i * 4 + 4, F.col("total")).alias("end")))
    out = E.left_truncated_regions(by.withColumn("ends", tokens), 40)
    return out.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in out.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_units, ingest_counts, facade_search, facade_stats, structure_fingerprints, knowledge_retrieve, syntax_check, fingerprint_scan, set_functions, json_fingerprints, comparison_statuses,
        stop_reasons, locations, prompt_templates, score_join, shard_files, task_files, first_references, calibration_files, run_metadata, strict_numbers, strict_means, unsupported_queries,
        left_truncation, resume_by_filter,
    )
}
