"""Scores, merges and summaries of retrieval-augmented generation and perplexity runs.

A run's records are rows; a summary is one aggregate with filters, a table by repository one grouped aggregate. Shards are partitions
of one DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_similarity, first_line, let, without_space
from ..tables import saved
from .quantiles import exact_medians, weighted_medians

# The targets that gaps are measured from, and labels of the metrics.
TARGET_EM, TARGET_ES = 0.25, 0.5877
GENERATION_POLICY, STOP_BOUNDARY = "single_line_generation", "policy_controlled_single_line"
DEFINITIONS = {
    "metric_definition_em": "exact match after removing all whitespace characters",
    "metric_definition_es": "edit similarity after removing all whitespace characters",
    "strict_metric_definition_em": "exact match on the first generated line",
    "strict_metric_definition_es": "edit similarity on the first generated line",
    "metric_scope": "reference_applied",
}
STATUSES = ["ok", "no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "invalid_groundtruth", "runtime_error"]
SIDES = ["no_reference", "with_reference"]
METRICS = ["em", "es", "strict_em", "strict_es"]
SCORE_COLUMNS = (
    ["normalized_groundtruth"]
    + [f"normalized_prediction_{s}" for s in SIDES]
    + [f"{m}_{s}" for m in METRICS for s in SIDES]
    + [f"{m}_improvement_abs" for m in METRICS]
)


# shards, splits, resumption


def indexed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines without blank ones, with sample_index counting those that are left, in the order of files by path and of lines in them.

    lines: a read of text files. Numbers come from the sizes of the pieces that tasks read and places within them, so one small aggregate is all that is gathered.
    """
    m = "_metadata"
    kept = lines.where(F.length(F.trim(F.regexp_replace(value, r"\s+", " "))) > 0)
    kept = kept.select("*", F.col(f"{m}.file_path").alias("f_"), F.col(f"{m}.file_block_start").alias("b_")).withColumn("m_", F.monotonically_increasing_id())
    piece = ["f_", "b_"]
    sizes = kept.groupBy(*piece).agg(F.count("*").alias("n_"))
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("m_"))
    return kept.withColumn("i_", place).join(F.broadcast(sizes), piece).withColumn("sample_index", F.col("i_") - 1 + F.col("before_")).drop("m_", "n_", "before_", "i_", *piece)


def shard(df: DataFrame, num_shards: int, rank: int, index: str = "sample_index") -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(num_shards)) == rank)


def split(df: DataFrame, mod: int, rem: int, task: str = "task_id", index: str = "sample_index") -> DataFrame:
    """Rows whose numeric task id, or else index, leaves rem; mod 0 is no split."""
    if mod <= 0:
        return df
    number = F.coalesce(F.expr(f"try_cast({task} as bigint)"), F.col(index))
    return df.where(F.pmod(number, F.lit(mod)) == rem)


def remaining(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that have no record yet."""
    finished = done.select(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("done_")).distinct()
    return tasks.join(finished, F.col(key).cast("string") == F.col("done_"), "left_anti")


def merged(shards: Iterable[DataFrame]) -> DataFrame:
    """The union of all shards by column name; columns that a shard lacks are NULL."""
    out = None
    for s in shards:
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    if out is None:
        raise ValueError("no shards")
    return out


def duplicate_tasks(records: DataFrame, key: str = "task_id") -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_tasks(records: DataFrame, key: str = "task_id") -> DataFrame:
    """The records; running them raises if a task id occurs twice."""
    n = records.groupBy(key).agg(F.count("*").alias("n_"))
    checked = n.select(key, F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("duplicate task_id "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean").alias("once_"))
    return records.join(checked, records[key].eqNullSafe(checked[key]), "inner").where("once_").drop(checked[key]).drop("once_")


# scores


def with_scores(records: DataFrame, groundtruth: str = "groundtruth") -> DataFrame:
    """Records (groundtruth, prediction_no_reference, prediction_with_reference) with SCORE_COLUMNS.

    Only first lines count. em and es compare them without any white space, the strict ones as they are. A NULL prediction has NULL
    scores; an improvement is with - no, NULL if either is.
    """
    out = records.withColumn("truth_", first_line(groundtruth)).withColumn("normalized_groundtruth", without_space(first_line(groundtruth)))
    for side in SIDES:
        prediction = F.col(f"prediction_{side}")
        line = F.when(prediction.isNotNull(), first_line(prediction))
        out = out.withColumn("line_", line).withColumn(f"normalized_prediction_{side}", without_space(F.col("line_")))
        norm, truth = F.col(f"normalized_prediction_{side}"), F.col("normalized_groundtruth")
        out = out.withColumns(
            {
                f"em_{side}": (norm == truth).cast("double"),
                f"es_{side}": F.when(norm.isNotNull(), edit_similarity(norm, truth)),
                f"strict_em_{side}": (F.col("line_") == F.col("truth_")).cast("double"),
                f"strict_es_{side}": F.when(F.col("line_").isNotNull(), edit_similarity(F.col("line_"), F.col("truth_"))),
            }
        )
    return out.withColumns({f"{m}_improvement_abs": F.col(f"{m}_with_reference") - F.col(f"{m}_no_reference") for m in METRICS}).drop("truth_", "line_")


def score_join(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records with their task's groundtruth by sample_index; running it raises where there is no such task."""
    truth = tasks.select(F.col("sample_index").alias("task_"), "groundtruth")
    joined = records.drop("groundtruth").join(truth, F.col("sample_index") == F.col("task_"), "left")
    bad = F.raise_error(F.concat(F.lit("no task with sample_index "), F.coalesce(F.col("sample_index").cast("string"), F.lit("NULL"))))
    return with_scores(joined.withColumn("task_", F.when(F.col("task_").isNull(), bad.cast("bigint")).otherwise(F.col("task_"))).where("task_ is not null").drop("task_"))


def valid() -> Column:
    return F.col("em_no_reference").isNotNull() & F.col("es_no_reference").isNotNull()


def applied() -> Column:
    return F.coalesce(F.col("reference_applied"), F.lit(False)) & F.col("em_with_reference").isNotNull() & F.col("es_with_reference").isNotNull()


def ppl_valid() -> Column:
    return F.col("log_ppl_no_reference").isNotNull()


def ppl_applied() -> Column:
    return F.coalesce(F.col("reference_applied"), F.lit(False)) & F.col("log_ppl_no_reference").isNotNull() & F.col("log_ppl_with_reference").isNotNull()


def log_ppl(logprobs: Column | str) -> Column:
    """Mean negative log probability of the groundtruth's tokens, from an array of log probabilities; NULL if empty."""
    a = F.col(logprobs) if isinstance(logprobs, str) else logprobs
    return F.when(F.size(a) > 0, -F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def _mean(name: str, where: Column) -> Column:
    return F.avg(F.when(where, F.col(name).cast("double")))


def _rate(flag: Column, where: Column) -> Column:
    return F.avg(F.when(where, F.coalesce(flag, F.lit(False)).cast("double")))


def _status_counts(*names: str) -> dict[str, Column]:
    return {f"samples_{n}": F.count_if(F.col("comparison_status") == n) for n in names}


# summaries: what they hold is told once, and worked out either over records or over states of shards


@dataclass(frozen=True)
class Field:
    """A summary's column: count (rows where), mean or median (of value where), first (value of the record of least sample_index), or text (a constant)."""

    kind: str
    value: Column | None = None
    where: Column | None = None
    type: str = "string"

    def chosen(self) -> Column:
        return F.when(self.where, self.value.cast("double"))


def _counts(**where: Column) -> dict[str, Field]:
    return {k: Field("count", where=w) for k, w in where.items()}


def _status_fields(*names: str) -> dict[str, Field]:
    return {f"samples_{n}": Field("count", where=F.col("comparison_status") == n) for n in names}


def _integer(name: str) -> Column:
    """The value of an integer or truth column; of numbers of other types those without a fraction; texts, also such as look like numbers, have none."""
    c = F.col(name)
    number, kind = c.try_cast("double"), F.typeof(c)
    whole = F.when(number == F.floor(number), number)
    return F.when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), number).when(kind.rlike("^(double|float|decimal)"), whole)


def _whole(name: str, where: Column) -> Field:
    """The mean of an integer column; what isn't an integer is left out."""
    return Field("mean", _integer(name), where)


def generation_fields() -> dict[str, Field]:
    """Counts, means and medians of scored records in three scopes: applied, all valid, and strict in both."""
    ok, used, every = valid(), applied(), F.lit(True)
    fallback = F.contains(F.coalesce(F.col("prompt_extraction_mode_used"), F.lit("")), F.lit("fallback"))
    first = lambda name, kind="string": Field("first", F.col(name), type=kind)
    rate = lambda flag, where: Field("mean", F.coalesce(flag, F.lit(False)), where)
    out: dict[str, Field] = {
        "prompt_mode": first("prompt_mode"),
        "prompt_builder_requested": first("prompt_builder_requested"),
        "prompt_builder": first("prompt_extraction_mode_used"),
        "stop_policy": first("stop_policy"),
        "decode_policy": first("decode_policy"),
        "beam_size": first("beam_size", "int"),
        "reference_shots": first("reference_shots_requested", "int"),
        "max_new_tokens": first("max_new_tokens_requested", "int"),
        **{k: Field("text", F.lit(v)) for k, v in DEFINITIONS.items()},
        "target_em_no_reference": Field("text", F.lit(TARGET_EM)),
        "target_es_no_reference": Field("text", F.lit(TARGET_ES)),
        **_counts(samples_total=every, samples_valid=ok, samples_with_reference_candidates=F.col("reference_candidates_considered") > 0, samples_with_reference_applied=used),
        **_status_fields("no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "runtime_error"),
    }
    for m in ("em", "es"):
        change = F.col(f"{m}_improvement_abs")
        out |= _counts(**{f"{m}_improved_count": used & (change > 0), f"{m}_worse_count": used & (change < 0), f"{m}_same_count": used & (change == 0)})
    scopes = [("", f"{m}{tail}", used) for m in ("em", "es") for tail in ("_no_reference", "_with_reference", "_improvement_abs")]
    for m in ("em", "es"):
        scopes += [("all_valid_", f"{m}_no_reference", ok), *[("", f"strict_{m}_{side}", used) for side in SIDES], ("all_valid_", f"strict_{m}_no_reference", ok)]
    for scope, name, where in scopes:
        strict, bare = ("strict_", name.removeprefix("strict_")) if name.startswith("strict_") else ("", name)
        for kind in ("mean", "median"):
            out[f"{scope}{strict}{kind}_{bare}"] = Field(kind, F.col(name), where)
    out |= {
        "empty_prediction_rate_no_reference": rate(F.col("empty_prediction_no_reference"), ok),
        "empty_prediction_rate_with_reference": rate(F.col("empty_prediction_with_reference"), used),
        "docstring_found_rate": rate(F.col("docstring_found"), ok),
        "prompt_extraction_fallback_rate": rate(fallback, ok),
    }
    for name, where in (("groundtruth", ok), ("reference", used), ("prediction_no_reference", ok), ("prediction_with_reference", used)):
        column = f"{name}_token_count" if "prediction" not in name else f"prediction_token_count_{name.removeprefix('prediction_')}"
        out[f"mean_{column}"] = _whole(column, where)
    return out | {"mean_reference_used_count": _whole("reference_used_count", used)}


def _generation_rest(row: DataFrame) -> DataFrame:
    """What follows from other columns of a generation summary."""
    named = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return row.withColumns(
        {
            "generation_policy": named("decode_policy", GENERATION_POLICY),
            "stop_boundary": named("stop_policy", STOP_BOUNDARY),
            "gap_to_target_em": F.lit(TARGET_EM) - F.col("mean_em_no_reference"),
            "gap_to_target_es": F.lit(TARGET_ES) - F.col("mean_es_no_reference"),
        }
    )


def ppl_fields() -> dict[str, Field]:
    ok, used = ppl_valid(), ppl_applied()
    change = F.col("log_ppl_improvement_abs")
    out = {
        "reference_shots": Field("first", F.col("reference_shots_requested"), type="int"),
        "prompt_tail_lines": Field("first", F.col("prompt_tail_lines_requested"), type="int"),
        "metric_scope": Field("text", F.lit(DEFINITIONS["metric_scope"])),
        **_counts(samples_total=F.lit(True), samples_valid=ok, samples_with_reference_candidates=F.col("reference_candidates_considered") > 0, samples_with_reference_applied=used),
        **_status_fields(*STATUSES[1:]),
        **_counts(improved_count=used & (change > 0), worse_count=used & (change < 0), same_count=used & (change == 0)),
        **{f"mean_{n}": Field("mean", F.col(n), used) for n in ("log_ppl_no_reference", "log_ppl_with_reference", "log_ppl_improvement_abs")},
        "all_valid_mean_log_ppl_no_reference": Field("mean", F.col("log_ppl_no_reference"), ok),
    }
    for name in ("groundtruth_token_count", "prompt_tail_line_count_observed", "prompt_tail_token_count_full", "prompt_token_count_used_no_reference"):
        out[f"mean_{name}"] = _whole(name, ok)
    for name in ("prompt_token_count_used_with_reference", "reference_token_count", "reference_used_count"):
        out[f"mean_{name}"] = _whole(name, used)
    return out


def summarise(records: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """One row with all fields, from records: one aggregate, and the passes that medians take, over what the fields need of the records."""
    needed = {"count": lambda f: f.where, "mean": Field.chosen, "median": Field.chosen, "first": lambda f: f.value}
    base = records.select(F.col("sample_index").alias("sample_index"), *[needed[f.kind](f).alias(k) for k, f in fields.items() if f.kind in needed])
    medians = [k for k, f in fields.items() if f.kind == "median"]
    base = saved(base) if medians else base
    made = {"count": lambda k, f: F.count_if(k), "mean": lambda k, f: F.avg(k), "first": lambda k, f: F.min_by(k, "sample_index"), "text": lambda k, f: F.first(f.value)}
    row = base.agg(*[made[f.kind](k, f).alias(k) for k, f in fields.items() if f.kind != "median"])
    return row.crossJoin(F.broadcast(exact_medians(base, {k: F.col(k) for k in medians}))).select(*fields) if medians else row


#: A state's rows: counts (n), means (n and total), firsts (text of the record least), and how often a value is met (value, n).
STATE = "name string, kind string, n long, total double, least long, text string, value double"


def summary_state(records: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """What a shard's records add to a summary: a few rows, and for medians a row for each different value."""
    none = lambda kind: F.lit(None).cast(kind)

    def row(name: str, kind: str, n=None, total=None, least=None, text=None) -> Column:
        n, total, least, text = (none(t) if c is None else c.cast(t) for c, t in ((n, "long"), (total, "double"), (least, "long"), (text, "string")))
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), n.alias("n"), total.alias("total"), least.alias("least"), text.alias("text"), none("double").alias("value"))

    rows = []
    for k, f in fields.items():
        if f.kind == "count":
            rows.append(row(k, f.kind, F.count_if(f.where)))
        elif f.kind == "mean":
            rows.append(row(k, f.kind, F.count(f.chosen()), F.sum(f.chosen())))
        elif f.kind == "first":
            rows.append(row(k, f.kind, least=F.min("sample_index"), text=F.min_by(f.value.cast("string"), F.col("sample_index"))))
    told = records.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    pairs = [F.struct(F.lit(k).alias("name"), f.chosen().alias("value")) for k, f in fields.items() if f.kind == "median"]
    if not pairs:
        return told
    met = records.select(F.explode(F.array(*pairs)).alias("x")).where("x.value is not null and not isnan(x.value)").groupBy("x.name", "x.value").agg(F.count("*").alias("n"))
    met = met.select("name", F.lit("median").alias("kind"), "n", none("double").alias("total"), none("long").alias("least"), none("string").alias("text"), "value")
    return told.unionByName(met)


def merged_summary(states: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """The summary of all records whose shards' states these are; no record is read."""
    here = lambda k, c: F.when((F.col("name") == k) & (F.col("kind") != "median"), c)
    made = {
        "count": lambda k, f: F.coalesce(F.sum(here(k, F.col("n"))), F.lit(0)),
        "mean": lambda k, f: F.sum(here(k, F.col("total"))) / F.nullif(F.sum(here(k, F.col("n"))), F.lit(0)),
        "first": lambda k, f: F.min_by(F.col("text"), here(k, F.col("least"))).cast(f.type),
        "text": lambda k, f: F.first(f.value),
    }
    row = states.agg(*[made[f.kind](k, f).alias(k) for k, f in fields.items() if f.kind != "median"])
    medians = [k for k, f in fields.items() if f.kind == "median"]
    if not medians:
        return row
    return row.crossJoin(F.broadcast(weighted_medians(states.where("kind = 'median'").select("name", "value", "n"), medians))).select(*fields)


def generation_summary(records: DataFrame) -> DataFrame:
    """Scored records -> one row with counts, means and medians in three scopes: applied, all valid, and strict in both."""
    return _generation_rest(summarise(records, generation_fields()))


def merged_generation_summary(states: DataFrame) -> DataFrame:
    """As generation_summary(), from states of shards: summary_state(records, generation_fields())."""
    return _generation_rest(merged_summary(states, generation_fields()))


def ppl_summary(records: DataFrame) -> DataFrame:
    return summarise(records, ppl_fields())


def ppl_improvement(records: DataFrame) -> DataFrame:
    """With log_ppl_improvement_abs: no - with, as less is better."""
    return records.withColumn("log_ppl_improvement_abs", F.col("log_ppl_no_reference") - F.col("log_ppl_with_reference"))


def _repository() -> Column:
    return F.coalesce(F.nullif(F.col("repository"), F.lit("")), F.lit("UNKNOWN"))


def generation_by_repository(records: DataFrame) -> DataFrame:
    used = applied()
    names = ["em_no_reference", "em_with_reference", "es_no_reference", "es_with_reference", "em_improvement_abs", "es_improvement_abs"]
    rows = records.groupBy(_repository().alias("repository")).agg(
        F.count("*").alias("samples"), F.count_if(used).alias("applied_samples"), *[_mean(n, used).alias(f"mean_{n}") for n in names]
    )
    return rows.orderBy("repository")


def ppl_by_repository(records: DataFrame) -> DataFrame:
    used, all_ = ppl_applied(), F.lit(True)
    rows = records.groupBy(_repository().alias("repository")).agg(
        F.count("*").alias("samples"),
        F.count_if(used).alias("applied_samples"),
        *[_mean(n, used).alias(f"mean_{n}") for n in ("log_ppl_no_reference", "log_ppl_with_reference", "log_ppl_improvement_abs")],
        F.count_if(used & (F.col("log_ppl_improvement_abs") > 0)).alias("improved_count"),
        _mean("groundtruth_token_count", all_).alias("mean_groundtruth_token_count"),
        _mean("reference_token_count", used).alias("mean_reference_token_count"),
        _mean("prompt_tail_token_count_full", all_).alias("mean_prompt_tail_token_count_full"),
    )
    return rows.orderBy("repository")


def shard_summaries(records: DataFrame) -> DataFrame:
    """By shard_rank, before scores exist: counts of predictions and statuses, and means over what was generated."""
    plain, helped = F.col("prediction_no_reference").isNotNull(), F.col("prediction_with_reference").isNotNull()
    fallback = F.contains(F.coalesce(F.col("prompt_extraction_mode_used"), F.lit("")), F.lit("fallback"))
    out = {
        "samples_total": F.count("*"),
        "samples_generated_no_reference": F.count_if(plain),
        "samples_generated_with_reference": F.count_if(helped),
        "samples_with_reference_candidates": F.count_if(F.col("reference_candidates_considered") > 0),
        **_status_counts("no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "runtime_error"),
        "empty_prediction_rate_no_reference": _rate(F.col("empty_prediction_no_reference"), plain),
        "empty_prediction_rate_with_reference": _rate(F.col("empty_prediction_with_reference"), helped),
        "docstring_found_rate": _rate(F.col("docstring_found"), plain),
        "prompt_extraction_fallback_rate": _rate(fallback, plain),
    }
    for name, where in (
        ("groundtruth_token_count", plain), ("prompt_token_count_used_no_reference", plain), ("prompt_token_count_used_with_reference", helped), ("reference_token_count", helped),
        ("reference_used_count", helped), ("prediction_token_count_no_reference", plain), ("prediction_token_count_with_reference", helped),
    ):
        out[f"mean_{name}"] = _mean(name, where)
    return records.groupBy("shard_rank").agg(*[c.alias(k) for k, c in out.items()])


def ppl_shard_summaries(records: DataFrame) -> DataFrame:
    ok, used = ppl_valid(), ppl_applied()
    out = {
        "samples_total": F.count("*"),
        "samples_valid": F.count_if(ok),
        "samples_with_reference_candidates": F.count_if(F.col("reference_candidates_considered") > 0),
        "samples_with_reference_applied": F.count_if(used),
        **_status_counts(*STATUSES[1:]),
        "mean_log_ppl_no_reference": _mean("log_ppl_no_reference", used),
        "mean_log_ppl_with_reference": _mean("log_ppl_with_reference", used),
        "mean_log_ppl_improvement_abs": _mean("log_ppl_improvement_abs", used),
    }
    return records.groupBy("shard_rank").agg(*[c.alias(k) for k, c in out.items()])


def augmented(tasks: DataFrame, records: DataFrame, field: str, columns: list[str] | None = None) -> DataFrame:
    """Tasks that have a record, with the record as a struct column (gen_eval, log_ppl_eval)."""
    columns = columns or [c for c in records.columns if c != "groundtruth"]
    told = records.select("sample_index", F.struct(*columns).alias(field))
    return tasks.join(told, "sample_index").orderBy("sample_index")


# calibration


def calibration_best(ranked: DataFrame) -> DataFrame:
    """One row: all ranked runs as an array, and the best one (NULL if there is none)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in ranked.columns if c != "rank"]).alias("run"))))
    return ranked.agg(rows.alias("rows")).select("rows", F.try_element_at("rows", F.lit(1)).alias("best"))


def calibration_ranking(rows: DataFrame) -> DataFrame:
    """Runs by EM, ES, fewest empty predictions, then prompt builder and decoding code, all descending; rank from 1.

    Codes are 0 for strict, 1 for plus_local8, 2 for others, and 0 for greedy, 1 for others; so the larger code wins a tie.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    keys = [
        F.desc(zero("mean_em_no_reference")),
        F.desc(zero("mean_es_no_reference")),
        F.desc(-zero("empty_prediction_rate_no_reference")),
        F.desc(F.when(F.col("prompt_builder") == "strict", 0).when(F.col("prompt_builder") == "plus_local8", 1).otherwise(2)),
        F.desc(F.when(F.col("decode_policy") == "greedy", 0).otherwise(1)),
    ]
    return rows.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(*keys, *([F.col("run_dir")] if "run_dir" in rows.columns else []))))


def needs_longer_rerun(ranked: DataFrame, most_empty: float = 0.15) -> DataFrame:
    """The two first runs if the best one leaves more than that share of predictions empty, else none."""
    best = ranked.where("rank = 1").select((F.coalesce("empty_prediction_rate_no_reference", F.lit(0.0)) > most_empty).alias("again"))
    return ranked.where("rank <= 2").join(F.broadcast(best.where("again")), how="inner").drop("again")


# token budgets


def first_references(tasks: DataFrame, shots: int) -> DataFrame:
    """Tasks with the first `shots` of their references, none as an empty array."""
    kind = dict(tasks.dtypes)["references"]
    return tasks.withColumn("references", F.slice(F.coalesce("references", F.expr(f"cast(array() as {kind})")), 1, max(shots, 0)))


def pack_references(segments: DataFrame, max_context: int, max_reference: int, max_new: int) -> DataFrame:
    """segments (sample_index, position, path, tokens, prompt_tokens) -> one row per sample: what fits the token budget.

    The prompt keeps its last tokens after the references' reserve; references are taken in order until the budget ends, the last perhaps cut.
    A sample without references has one row with NULL position.
    """
    available = max(max_context - max_new, 0)
    sample = Window.partitionBy("sample_index")
    so_far = sample.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce("tokens", F.lit(0))
    s = segments.withColumns({"total": F.sum(length).over(sample), "before": F.coalesce(F.sum(length).over(so_far), F.lit(0))})
    reserve = F.least(F.lit(max_reference), F.col("total"), F.lit(available))
    s = s.withColumn("prompt_used", F.least(F.col("prompt_tokens"), F.greatest(F.lit(available) - reserve, F.lit(0))))
    s = s.withColumn("budget", F.least(F.lit(max_reference), F.greatest(F.lit(available) - F.col("prompt_used"), F.lit(0))))
    s = s.withColumn("take", F.least(length, F.greatest(F.col("budget") - F.col("before"), F.lit(0))))
    used, cut = F.col("take") > 0, (F.col("take") > 0) & (F.col("take") < length)
    paths = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where & F.col("position").isNotNull(), F.struct("position", "path")))), lambda x: x["path"])
    return s.groupBy("sample_index").agg(
        F.sum("take").alias("reference_token_count"),
        F.first("total").alias("reference_token_count_total_considered"),
        F.count_if(used).alias("reference_used_count"),
        F.count_if(cut).cast("boolean").alias("reference_partially_truncated"),
        (F.sum("take") > 0).alias("reference_applied"),
        paths(used).alias("used_reference_paths"),
        paths(~used).alias("omitted_reference_paths"),
        F.count_if(~used & F.col("position").isNotNull()).alias("reference_omitted_count"),
        F.max(F.when(cut, F.col("path"))).alias("reference_truncated_path"),
        F.coalesce(F.max(F.when(cut, F.col("take"))), F.lit(0)).alias("reference_truncated_tokens_kept"),
        F.coalesce(F.max(F.when(cut, F.col("tokens"))), F.lit(0)).alias("reference_truncated_tokens_total"),
        F.lit(max(min(max_reference, available), 0)).alias("reference_budget_tokens_effective"),
        F.first("prompt_used").alias("prompt_token_count_used"),
        F.first("prompt_tokens").alias("prompt_token_count_full"),
        (F.first("prompt_used") < F.first("prompt_tokens")).alias("prompt_was_truncated"),
        (F.sum("take") + F.first("prompt_used")).alias("prefix_token_count_total"),
    )


def left_truncated_regions(samples: DataFrame, max_context: int) -> DataFrame:
    """samples (sample_index, ends: array of (start, end) token offsets, references: array of (path, length), prompt_length)
    -> how much of references and prompt the last max_context tokens keep. The text is references, prompt, groundtruth.

    status is invalid_groundtruth where the groundtruth has no token, or as many as the context holds. Each reference and each sample looks through the tokens a fixed
    number of times; what that gives is computed once and then only looked up.
    """
    zero = F.lit(0).cast("int")
    bounds = F.aggregate(
        "references",
        F.struct(zero.alias("at"), F.expr("cast(array() as array<struct<path: string, low: int, high: int>>)").alias("out")),
        lambda acc, r: F.struct((acc["at"] + r["length"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(r["path"].alias("path"), acc["at"].alias("low"), (acc["at"] + r["length"]).cast("int").alias("high")))).alias("out")),
    )
    count = lambda arr, test: F.size(F.filter(arr, test))

    def window(x: Column) -> Column:
        n = F.size(x["ends"])
        kept = F.when(n > max_context, F.slice(x["ends"], F.greatest(n - max_context + 1, F.lit(1)), max_context)).otherwise(x["ends"])
        return F.struct(x["ends"].alias("ends"), kept.alias("kept"), x["b"]["out"].alias("refs"), x["b"]["at"].alias("low"), (x["b"]["at"] + x["prompt_length"]).alias("target"))

    def begun(x: Column) -> Column:
        return x.withField("from", F.coalesce(F.try_element_at(x["kept"], F.lit(1))["start"], x["target"]))

    def counted(x: Column) -> Column:
        of_reference = lambda r: F.struct(
            r["path"].alias("path"), r["low"].alias("low"), r["high"].alias("high"),
            count(x["kept"], lambda t: (t["end"] > r["low"]) & (t["start"] < r["high"])).alias("meets"), count(x["ends"], lambda t: (t["end"] > r["low"]) & (t["end"] <= r["high"])).alias("whole"),
        )
        prompt = lambda arr: count(arr, lambda t: (t["end"] > x["low"]) & (t["end"] <= x["target"]))
        return F.struct(
            x["from"].alias("from"), F.transform(x["refs"], of_reference).alias("refs"), count(x["ends"], lambda t: t["end"] > x["target"]).alias("truth"), count(x["kept"], lambda t: t["end"] <= x["target"]).alias("prefix"),
            prompt(x["ends"]).alias("full"), prompt(x["kept"]).alias("used"), count(x["ends"], lambda t: t["end"] <= x["low"]).alias("considered"),
        )

    def told(x: Column) -> Column:
        over = lambda r: (r["low"] < x["from"]) & (x["from"] < r["high"])
        gone = lambda r: (r["whole"] == 0) | (r["high"] <= x["from"]) | (r["meets"] == 0) & ~over(r)
        part = lambda r: ~((r["whole"] == 0) | (r["high"] <= x["from"])) & over(r)
        return F.struct(x.alias("x"), F.filter(x["refs"], lambda r: ~gone(r)).alias("used"), F.filter(x["refs"], gone).alias("omitted"), F.filter(x["refs"], part).alias("cut"))

    whole = F.struct("ends", bounds.alias("b"), "prompt_length")
    for step in (window, begun, counted, told):
        whole = let(whole, step)
    s = samples.select("sample_index", whole.alias("s_"))
    x, used, omitted, cut = (F.col(f"s_.{c}") for c in ("x", "used", "omitted", "cut"))
    first_cut, some_cut = F.try_element_at(cut, F.lit(1)), F.size(cut) > 0
    of_references = x["prefix"] - x["used"]
    return s.select(
        "sample_index",
        F.when((x["truth"] == 0) | (x["truth"] >= max_context), "invalid_groundtruth").otherwise("ok").alias("status"),
        x["truth"].alias("groundtruth_token_count"),
        x["prefix"].alias("prefix_token_count"),
        x["full"].alias("prompt_token_count_full"),
        x["used"].alias("prompt_token_count_used"),
        of_references.alias("reference_token_count"),
        x["considered"].alias("reference_token_count_total_considered"),
        F.size(used).alias("reference_used_count"),
        F.size(omitted).alias("reference_omitted_count"),
        ((F.size(used) > 0) | (of_references > 0)).alias("reference_applied"),
        some_cut.alias("reference_partially_truncated"),
        first_cut["path"].alias("reference_truncated_path"),
        F.when(some_cut, first_cut["meets"]).otherwise(0).alias("reference_truncated_tokens_kept"),
        F.when(some_cut, first_cut["whole"]).otherwise(0).alias("reference_truncated_tokens_total"),
        F.transform(used, lambda r: r["path"]).alias("used_reference_paths"),
        F.transform(omitted, lambda r: r["path"]).alias("omitted_reference_paths"),
        (x["used"] < x["full"]).alias("prompt_was_truncated"),
    )


def comparison_status(candidates: Column, budget: Column, prompt_ok: Column, groundtruth_ok: Column, error: Column) -> Column:
    """The status of a sample: failures first, then why no reference was applied."""
    return (
        F.when(error.isNotNull(), "runtime_error")
        .when(~prompt_ok, "invalid_prompt_context")
        .when(~groundtruth_ok, "invalid_groundtruth")
        .when(candidates == 0, "no_reference_candidates")
        .when(budget <= 0, "reference_budget_zero")
        .otherwise("ok")
    )
