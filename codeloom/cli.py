"""Command line: update, stats, search, knowledge_retrieve, information_retrieve, batch_retrieve, sample, evaluate, summarise, calibrate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import by_extension
from .functions.text import tail_lines
from .knowledgebase import KnowledgeBase
from .operators import evaluate, retrieve
from .sources.files import read_shards, read_tasks, sample, write_calibration, write_csv, write_json
from .sources.shards import ShardLog, remaining_by_filter
from .tables import saved

KINDS = ["function", "method", "type", "global", "declaration_block"]


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def _max(text: str) -> int:
    n = int(text)
    if n != -1 and n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more, or -1")
    return n


def _check_evaluate(a: argparse.Namespace) -> None:
    """Ranges that depend on each other; raises ValueError."""
    if not 0 <= a.shard_rank < a.num_shards:
        raise ValueError("--shard-rank must be 0 or more and below --num-shards")
    if a.limit == 0 or a.limit < -1:
        raise ValueError("--limit must be -1 or 1 or more")
    if a.split_mod < 0 or a.split_mod and not 0 <= a.split_rem < a.split_mod:
        raise ValueError("--split-rem must be 0 or more and below --split-mod, which must not be negative")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--home", default="knowledgebase", help="folder of knowledge bases")
    sub = p.add_subparsers(dest="command")
    u = sub.add_parser("update")
    u.add_argument("--knowledge_path", required=True)
    u.add_argument("--knowledge_base", required=True)
    u.add_argument("--min_lines", type=int, default=0)
    u.add_argument("--workers", type=_positive, help="tasks that parse")
    u.add_argument("--overwrite", action="store_true", help="drop what the base holds before")
    s = sub.add_parser("stats")
    s.add_argument("--knowledge_base", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--knowledge_base", required=True)
    s.add_argument("--lang")
    s.add_argument("--repo")
    s.add_argument("--kind", choices=KINDS)
    s.add_argument("--shots", type=int, default=10)
    for name in ("knowledge_retrieve", "information_retrieve"):
        r = sub.add_parser(name)
        r.add_argument("input_file")
        r.add_argument("--knowledge_base", required=True)
        r.add_argument("--shots", type=int, default=5)
        r.add_argument("--lang")
        r.add_argument("--repo")
        r.add_argument("--max", type=int, default=-1)
        r.add_argument("--limit", type=int, default=-1)
    b = sub.add_parser("batch_retrieve")
    b.add_argument("input")
    b.add_argument("output")
    b.add_argument("--mode", choices=["knowledge", "information"], default="information")
    b.add_argument("--query_column", default="prompt")
    b.add_argument("--n", type=_positive, default=5, help="tail lines of the query")
    b.add_argument("--limit", type=int, default=-1)
    b.add_argument("--max", type=_max, default=100, help="units kept by containment before the greedy choice; -1 keeps all")
    b.add_argument("--batch_size", type=_positive, default=1000, help="rows that a Python worker gets at a time")
    b.add_argument("--max_workers", type=_positive, help="tasks of a shuffle")
    b.add_argument("--shots", type=int, default=10)
    b.add_argument("--knowledge_base", default="train")
    b.add_argument("--lang", default="C")
    x = sub.add_parser("sample", help="units picked by a seeded hash, as JSON lines")
    x.add_argument("output")
    x.add_argument("--knowledge_base", required=True)
    x.add_argument("--n", type=_positive, default=100)
    x.add_argument("--seed", type=int, default=42)
    e = sub.add_parser("evaluate", help="score one shard's predictions (generation) or log probabilities (ppl), which a model has made, and append them to its records")
    e.add_argument("kind", choices=["generation", "ppl"])
    e.add_argument("tasks")
    e.add_argument("predictions", help="JSON lines by sample_index: prediction_no_reference and prediction_with_reference, or logprobs_no_reference and logprobs_with_reference")
    e.add_argument("output")
    for name, kind, default in (("limit", int, -1), ("num-shards", _positive, 1), ("shard-rank", int, 0), ("split-mod", int, 0), ("split-rem", int, 0)):
        e.add_argument(f"--{name}", type=kind, default=default)
    e.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    c = sub.add_parser("calibrate", help="rank runs by their summaries")
    c.add_argument("output")
    c.add_argument("summaries", nargs="+", help="run folder=folder of its summary, or the latter alone")
    m = sub.add_parser("summarise")
    m.add_argument("kind", choices=["generation", "ppl"])
    m.add_argument("tasks")
    m.add_argument("shards")
    m.add_argument("output")
    m.add_argument("--num_shards", type=_positive, required=True)
    return p


def _print_results(df, scored: bool) -> None:
    for k, r in enumerate(df.collect(), 1):
        print(f"{k}. [{r.kind}] {r.qualified_name}  {r.repository}  {r.relative_path}:{r.start_line}-{r.end_line}" + (f"  score={r.score:.4f} containment={r.containment:.4f}" if scored else ""))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    base = lambda: KnowledgeBase(spark, f"{args.home}/{args.knowledge_base}", min_lines=getattr(args, "min_lines", 0))
    if args.command == "update":
        if not Path(args.knowledge_path).is_dir():
            print(f"no such directory: {args.knowledge_path}", file=sys.stderr)
            return 1
        for r in base().import_archives(args.knowledge_path, overwrite=args.overwrite, workers=args.workers).orderBy("repository").collect():
            for message in r.messages:
                print(f"{r.repository}: {message}", file=sys.stderr)
            print(f"{r.repository}: {r.files} files, {r.entries} entries ({r.distinct_entries} distinct), {r.errors} errors" + " (bad archive)" * bool(r.bad_archives))
    elif args.command == "stats":
        told = base().stats()
        print(f"total: {told['total']}")
        for d in ("language", "repository", "kind"):
            for value, n in sorted(told[f"by_{d}"].items(), key=str):
                print(f"{d} {value}: {n}")
    elif args.command == "search":
        _print_results(base().search(args.query, args.lang, args.repo, args.kind, args.shots), False)
    elif args.command in ("knowledge_retrieve", "information_retrieve"):
        text = Path(args.input_file).read_text(encoding="utf-8", errors="ignore")
        language = args.lang
        if args.command == "knowledge_retrieve":
            language = language or by_extension().get(Path(args.input_file).suffix)
            if not language:
                print("language unknown: give --lang", file=sys.stderr)
                return 1
        found = getattr(base(), args.command)([text], language, args.shots, args.repo, args.limit, args.max)
        _print_results(found.orderBy("rank"), True)
    elif args.command == "batch_retrieve":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(args.batch_size))
        if args.max_workers:
            spark.conf.set("spark.sql.shuffle.partitions", str(args.max_workers))
        tasks = read_tasks(spark, args.input, args.limit).withColumn("retrieval_query", tail_lines(args.query_column, args.n))
        queries = tasks.select(F.col("sample_index").alias("query_id"), F.col("retrieval_query").alias("text"))
        kb = base()
        method = kb.knowledge_retrieve if args.mode == "knowledge" else kb.information_retrieve
        out = saved(retrieve.augment(tasks.drop("references"), method(queries, args.lang, args.shots, max_candidates=args.max), args.mode, "sample_index"))
        write_json(out.drop("sample_index"), args.output)
        r = retrieve.hit_rate(out).first()
        print(f"hit rate {r.hit_rate:.4f} ({r.hits} of {r.tasks})")
    elif args.command == "sample":
        write_json(sample(base().load(), args.n, args.seed), args.output, ["id"], one_file=True)
    elif args.command == "evaluate":
        _check_evaluate(args)
        print(f"{evaluate_shard(args, spark)} records")
    elif args.command == "calibrate":
        runs = [(s.split("=", 1) if "=" in s else (s, s)) for s in args.summaries]
        rows = evaluate.merged([spark.read.json(at).withColumn("run_dir", F.lit(run)) for run, at in runs])
        ranked = saved(evaluate.calibration_ranking(rows))
        write_calibration(ranked, args.output)
        for r in ranked.orderBy("rank").collect():
            print(f"{r['rank']}. {r.run_dir}  em={r.mean_em_no_reference} es={r.mean_es_no_reference}")
        if not evaluate.needs_longer_rerun(ranked).isEmpty():
            print("the best run leaves many predictions empty: run the first two again with more new tokens")
    elif args.command == "summarise":
        tasks = read_tasks(spark, args.tasks)
        records = evaluate.unique_tasks(shard_records(args, spark))
        if args.kind == "generation":
            scored = saved(evaluate.score_join(records, tasks))
            summary, table, field = evaluate.generation_summary(scored), evaluate.generation_by_repository(scored), "gen_eval"
        else:
            scored = saved(evaluate.ppl_improvement(records))
            summary, table, field = evaluate.ppl_summary(scored), evaluate.ppl_by_repository(scored), "log_ppl_eval"
        write_json(scored, f"{args.output}/per_sample", ["sample_index"])
        write_json(summary, f"{args.output}/summary", one_file=True)
        write_csv(table, f"{args.output}/summary_by_repository", ["repository"])
        write_json(evaluate.augmented(tasks, scored, field), f"{args.output}/augmented")
    return 0


PREDICTED = {
    "generation": "sample_index long, prediction_no_reference string, prediction_with_reference string",
    "ppl": "sample_index long, logprobs_no_reference array<double>, logprobs_with_reference array<double>",
}
#: What else a model's run may say of a record, and what is left out where it doesn't.
NOTES = (
    "reference_applied boolean, reference_candidates_considered int, comparison_status string, prompt_mode string, prompt_builder_requested string, prompt_extraction_mode_used string, stop_policy string, "
    "decode_policy string, beam_size int, reference_shots_requested int, max_new_tokens_requested int, prompt_tail_lines_requested int, empty_prediction_no_reference boolean, empty_prediction_with_reference boolean, "
    "docstring_found boolean, groundtruth_token_count int, reference_token_count int, reference_used_count int, prediction_token_count_no_reference int, prediction_token_count_with_reference int, "
    "prompt_tail_line_count_observed int, prompt_tail_token_count_full int, prompt_token_count_used_no_reference int, prompt_token_count_used_with_reference int"
)
RECORDS = {
    "generation": f"task_id string, repository string, {PREDICTED['generation']}, {NOTES}",
    "ppl": f"task_id string, repository string, sample_index long, log_ppl_no_reference double, log_ppl_with_reference double, {NOTES}",
}


def evaluate_shard(args: argparse.Namespace, spark: SparkSession) -> int:
    """Records of one shard's tasks that have none yet, committed as a further part; how many there were."""
    log, schema = ShardLog(spark, args.output, args.shard_rank), T._parse_datatype_string(RECORDS[args.kind])
    if not args.resume:
        log.restart()
    tasks = read_tasks(spark, args.tasks, max(args.limit, 0)).select("sample_index", F.col("metadata.task_id").alias("task_id"), F.col("metadata.repository").alias("repository"))
    tasks = tasks.withColumn("task_id", F.coalesce("task_id", F.col("sample_index").cast("string")))
    mine = remaining_by_filter(evaluate.shard(evaluate.split(tasks, args.split_mod, args.split_rem), args.num_shards, args.shard_rank), log.read(schema))
    told = spark.read.schema(f"{PREDICTED[args.kind]}, {NOTES}").json(args.predictions)
    rows = mine.join(told, "sample_index")
    if args.kind == "ppl":
        rows = rows.withColumns({f"log_ppl_{s}": evaluate.log_ppl(f"logprobs_{s}") for s in evaluate.SIDES})
    return log.append(rows.select(*schema.names))


def shard_records(args: argparse.Namespace, spark: SparkSession):
    """Records of all shards: committed parts of this command line's runs, or files of JSON lines."""
    logs = [ShardLog(spark, args.shards, r) for r in range(args.num_shards)]
    if all(log.commits() for log in logs):
        return evaluate.merged([log.read(T._parse_datatype_string(RECORDS[args.kind])) for log in logs])
    return read_shards(spark, args.shards, args.num_shards)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 1
    try:
        return run(args, spark or SparkSession.builder.appName("codeloom").getOrCreate())
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
