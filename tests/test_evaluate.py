"""Scores, packing, merges and summaries on small rows."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import evaluate as E
from codeloom.operators.prompts import build, merge_blocks, nearest_comment


def test_scores(spark):
    rows = [(0, "a b\r\nmore", "a  b", None), (1, "", "", "x"), (2, None, "abc", "abd"), (3, "x y", "x y\nrest", "xy")]
    df = spark.createDataFrame(rows, "sample_index long, groundtruth string, prediction_no_reference string, prediction_with_reference string")
    s = {r.sample_index: r for r in E.with_scores(df).collect()}
    assert (s[0].em_no_reference, s[0].strict_em_no_reference, s[0].em_with_reference, s[0].em_improvement_abs) == (1.0, 0.0, None, None)
    assert (s[1].es_no_reference, s[1].em_no_reference, s[1].es_with_reference, s[1].es_improvement_abs) == (1.0, 1.0, 0.0, -1.0)
    assert s[2].es_no_reference == 0.0 and s[3].em_with_reference == 1.0 and s[3].strict_em_with_reference == 0.0 and s[3].strict_es_with_reference == pytest.approx(2 / 3)


def test_joins_and_checks(spark):
    tasks = spark.createDataFrame([(0, "a"), (1, "b")], "sample_index long, groundtruth string")
    rec = spark.createDataFrame([(1, "t1", "b", None)], "sample_index long, task_id string, prediction_no_reference string, prediction_with_reference string")
    assert E.score_join(rec, tasks).first().em_no_reference == 1.0
    with pytest.raises(Exception, match="no task"):
        E.score_join(rec.withColumn("sample_index", rec.sample_index + 5), tasks).collect()
    assert E.unique_tasks(rec).count() == 1
    with pytest.raises(Exception, match="duplicate task_id"):
        E.unique_tasks(rec.union(rec)).collect()
    assert E.remaining(spark.createDataFrame([("t1",), ("t2",)], "task_id string"), rec).first().task_id == "t2"
    assert E.split(rec, 0, 0).count() == 1 and E.shard(rec, 2, 1).count() == 1 and E.shard(rec, 2, 0).count() == 0
    assert E.augmented(tasks, rec, "gen_eval").first().gen_eval.task_id == "t1"


def test_blank_lines_do_not_count(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("a\n\n  \nb\nc\n")
    assert [(r.value, r.sample_index) for r in E.indexed(spark.read.text(str(tmp_path / "x.jsonl"))).orderBy("sample_index").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_empty_summaries(spark):
    from codeloom.plans.views import perplexities

    none = E.ppl_improvement(perplexities(spark, "/root/testdata/sf0.001")).limit(0)
    row = E.ppl_summary(none).first()
    assert row.samples_total == 0 and row.mean_log_ppl_no_reference is None and E.ppl_by_repository(none).count() == 0


def test_packing(spark):
    def pack(refs, prompt, context, most, new):
        rows = [(0, i, f"p{i}", n, prompt) for i, n in enumerate(refs)] or [(0, None, None, None, prompt)]
        return E.pack_references(spark.createDataFrame(rows, "sample_index long, position int, path string, tokens int, prompt_tokens int"), context, most, new).first()

    r = pack([30, 30, 30], 50, 100, 70, 10)
    assert (r.prompt_token_count_used, r.reference_token_count, r.used_reference_paths, r.omitted_reference_paths) == (20, 70, ["p0", "p1", "p2"], [])
    assert r.reference_partially_truncated and (r.reference_truncated_path, r.reference_truncated_tokens_kept, r.reference_truncated_tokens_total) == ("p2", 10, 30)
    r = pack([10, 50], 5, 100, 10, 10)
    assert (r.reference_token_count, r.used_reference_paths, r.omitted_reference_paths, r.prompt_was_truncated) == (10, ["p0"], ["p1"], False)
    r = pack([], 50, 40, 10, 10)
    assert (r.prompt_token_count_used, r.reference_applied, r.reference_omitted_count) == (30, False, 0)
    assert pack([5], 5, 10, 10, 20).reference_budget_tokens_effective == 0


def test_left_truncation(spark):
    schema = "sample_index long, ends array<struct<start: int, end: int>>, references array<struct<path: string, length: int>>, prompt_length int"
    ends = [(i, i + 1) for i in range(12)]
    df = spark.createDataFrame([(0, ends, [("a", 3), ("b", 4)], 3), (1, ends[:10], [("a", 3), ("b", 4)], 3)], schema)
    r = {x.sample_index: x for x in E.left_truncated_regions(df, 7).collect()}
    assert (r[0].status, r[0].groundtruth_token_count, r[0].used_reference_paths, r[0].omitted_reference_paths) == ("ok", 2, ["b"], ["a"])
    assert r[0].reference_partially_truncated and (r[0].reference_truncated_tokens_kept, r[0].reference_truncated_tokens_total, r[0].prompt_token_count_used) == (2, 4, 3)
    assert r[1].status == "invalid_groundtruth"


def test_left_truncation_of_long_texts_takes_one_pass_a_reference(spark):
    """One sample of 40 references of 50 tokens: looking for the cut reference at every token takes minutes."""
    import time

    schema = "sample_index long, ends array<struct<start: int, end: int>>, references array<struct<path: string, length: int>>, prompt_length int"
    df = spark.createDataFrame([(0, [(i, i + 1) for i in range(2030)], [(f"p{i}", 50) for i in range(40)], 20)], schema)
    began = time.monotonic()
    r = E.left_truncated_regions(df, 1505).first()
    assert time.monotonic() - began < 30
    assert (r.status, r.groundtruth_token_count, r.reference_used_count, r.reference_omitted_count) == ("ok", 10, 30, 10)
    assert (r.reference_truncated_path, r.reference_truncated_tokens_kept, r.reference_truncated_tokens_total) == ("p10", 25, 50) and r.used_reference_paths[0] == "p10"


def test_calibration(spark):
    rows = [("a", "strict", "greedy", 0.5, 0.5, 0.2), ("b", "plus_local16", "beam", 0.5, 0.5, 0.2), ("c", "strict", "beam", 0.6, 0.1, 0.3), ("d", "strict", "greedy", None, None, None)]
    df = spark.createDataFrame(rows, "run_dir string, prompt_builder string, decode_policy string, mean_em_no_reference double, mean_es_no_reference double, empty_prediction_rate_no_reference double")
    ranked = E.calibration_ranking(df)
    assert [r.run_dir for r in ranked.orderBy("rank").collect()] == ["c", "b", "a", "d"]
    assert {r.run_dir for r in E.needs_longer_rerun(ranked).collect()} == {"c", "b"}


def test_prompt_parts():
    code = "// sums\n// two\nint add(int a,\n        int b)\n{\n    int c = a;\n"
    text, mode, doc, kind, local, n, chars = build(code, "strict")
    assert (mode, doc, kind, local) == ("strict", True, "function_signature", 0) and text.startswith("// sums\n// two") and "int add" in text and chars == len(text) and n == len(text.splitlines())
    assert build("\n \n", "strict")[1:4] == ("strict_empty", False, "empty") and build(None, "plus_local8")[3] == "empty"
    assert build("typedef struct {\n  int a;\n", "strict")[3] == "type_declaration" and build("x = 1;\ny = 2;\n", "plus_local16")[3:5] == ("local_scope", 16)
    assert merge_blocks("a\nb", "b\nc") == "a\nb\nc" and merge_blocks("a", "x\na") == "x\na" and merge_blocks("a\n", "\nb", "\n\n") == "a\n\nb" and merge_blocks("", "b") == "b"
    assert nearest_comment(["/* a", "b */", "int x;"], 2) == "/* a\nb */" and nearest_comment(["// a"] + [""] * 30, 30) == "" and nearest_comment([], -1) == ""


def test_exact_medians(spark):
    """Against sorting: ties, one value, none, tiny and huge numbers, infinite ones, even and odd numbers of them."""
    import random
    import statistics

    from codeloom.operators.quantiles import exact_medians, weighted_medians

    rng = random.Random(6)
    most = 1.7976931348623157e308
    columns = {
        "ties": [rng.choice([0.0, 1.0]) for _ in range(400)],
        "spread": [rng.choice([1, -1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(399)],
        "near": [1.0 + rng.random() * 1e-12 for _ in range(400)],
        "ends": [-most, most, 0.5, float("inf"), float("-inf"), 0.25, 5e-324, -5e-324],
        "one": [7.5],
        "none": [],
        "odd": [float("nan"), 2.0, 1.0, None],
    }
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in columns))
    got = exact_medians(df, {k: F.col(k) for k in columns}).first().asDict()
    plain = {k: [max(-most, min(most, x)) for x in v if x is not None and x == x] for k, v in columns.items()}
    assert got == {k: statistics.median(v) if v else None for k, v in plain.items()}
    counted = spark.createDataFrame([(k, x, 2 if i % 2 else 1) for k in ("ties", "spread") for i, x in enumerate(columns[k])] + [("none", 1.0, 1), ("none", 1.0, -1)], "name string, value double, n long")
    want = {k: statistics.median([x for i, x in enumerate(columns[k]) for _ in range(2 if i % 2 else 1)]) for k in ("ties", "spread")}
    assert weighted_medians(counted, ["ties", "spread", "none"]).first().asDict() == want | {"none": None}


def test_states_of_shards_merge_to_the_summary(spark):
    """Also where shards are empty, hold no valid record, or come in another order."""
    from codeloom.operators import evaluate as E

    rng = __import__("random").Random(3)
    rows = [(i, "abc" * (i % 3), rng.choice(["abc", "abd", "", None]), rng.choice(["abc", "x", None]), i % 4 > 0, i % 3, rng.choice(E.STATUSES), f"mode{i}", i) for i in range(5, 60)]
    df = spark.createDataFrame(rows, "sample_index long, groundtruth string, prediction_no_reference string, prediction_with_reference string, reference_applied boolean, reference_candidates_considered int, comparison_status string, prompt_mode string, beam_size int")
    more = ["prompt_builder_requested", "prompt_extraction_mode_used", "stop_policy", "decode_policy"]
    df = df.withColumns({c: F.lit("greedy") for c in more} | {c: F.lit(3) for c in ("reference_shots_requested", "max_new_tokens_requested", "groundtruth_token_count", "reference_token_count", "prediction_token_count_no_reference", "prediction_token_count_with_reference", "reference_used_count")} | {c: F.col("sample_index") % 7 == 0 for c in ("empty_prediction_no_reference", "empty_prediction_with_reference", "docstring_found")})
    scored = E.with_scores(df)
    shards = [scored.where(c) for c in ("sample_index >= 30", "sample_index < 20", "false", "sample_index between 20 and 29")]
    state = E.merged([E.summary_state(s, E.generation_fields()) for s in shards])
    assert state.columns == [c.split()[0] for c in E.STATE.split(", ")]
    got, want = E.merged_generation_summary(state).first().asDict(), E.generation_summary(scored).first().asDict()
    assert set(got) == set(want) and got["prompt_mode"] == "mode5" and got["beam_size"] == 5 and isinstance(got["beam_size"], int)
    for k in want:
        assert got[k] == want[k] or abs(got[k] - want[k]) < 1e-12, k
    none = E.merged_generation_summary(E.summary_state(scored.limit(0), E.generation_fields())).first()
    assert none.samples_total == 0 and none.mean_em_no_reference is None and none.median_es_no_reference is None


@pytest.mark.parametrize("kind,values,want", [("long", [1, 2, None], 1.5), ("boolean", [True, False, True], 2 / 3), ("double", [4.0, 3.5, 6.0], 5.0), ("string", ["4", "x", None], None)])
def test_means_of_integers_skip_the_rest(spark, kind, values, want):
    from codeloom.operators import evaluate as E

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"sample_index long, n {kind}")
    field = {"mean_n": E._whole("n", F.lit(True))}
    for row in (E.summarise(df, field), E.merged_summary(E.summary_state(df, field), field)):
        assert row.first().mean_n == (want if want is None else pytest.approx(want))
