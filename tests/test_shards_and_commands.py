"""Shard logs, resumption, and the commands that write."""

import json
import zipfile

import pytest

import codeloom
from codeloom import KnowledgeBase
from codeloom.cli import main
from codeloom.operators.evaluate import remaining
from codeloom.sources.shards import ShardLog, remaining_by_filter

SCHEMA = "sample_index long, task_id string"


def frame(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def ids(df):
    return sorted(r.sample_index for r in df.collect())


def test_a_part_counts_once_it_is_committed(spark, tmp_path, monkeypatch):
    log, schema = ShardLog(spark, str(tmp_path), 3), frame(spark, []).schema
    assert ids(log.read(schema)) == [] and log.append(frame(spark, [])) == 0 and log.commits() == {}
    assert log.append(frame(spark, [4, 1])) == 2
    monkeypatch.setattr(log, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed between write and commit
    with pytest.raises(KeyboardInterrupt):
        log.append(frame(spark, [5, 6]))
    again = ShardLog(spark, str(tmp_path), 3)
    assert ids(again.read(schema)) == [1, 4] and len([p for p in (tmp_path / "per_sample.rank3").iterdir() if p.name.startswith("part")]) == 2
    left = remaining_by_filter(frame(spark, range(8)), again.read(schema))
    assert ids(left) == [0, 2, 3, 5, 6, 7] and again.append(left) == 6
    assert ids(again.read(schema)) == list(range(8))
    again.restart()
    assert ids(again.read(schema)) == []


def test_a_torn_part_is_refused(spark, tmp_path):
    log, schema = ShardLog(spark, str(tmp_path), 0), frame(spark, []).schema
    log.append(frame(spark, range(5)).coalesce(1))
    part = next(p for p in (tmp_path / "per_sample.rank0").glob("part*/part*.json") if p.stat().st_size)
    whole = part.read_bytes()
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(whole[:-8])
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        ids(log.read(schema))
    part.write_bytes(whole[: whole.rindex(b"{")])
    with pytest.raises(ValueError, match="not the 5"):
        log.read(schema)


@pytest.mark.parametrize("pages", [0, 2048])
def test_the_filter_changes_nothing(spark, pages, monkeypatch):
    monkeypatch.setattr("codeloom.sources.shards.PAGES", pages)
    tasks = spark.createDataFrame([(i, None if i % 50 == 3 else f"t{i}") for i in range(400)] + [(7, "t7")], SCHEMA)
    for done in ([], ["t1"], ["None", "t2", None], [f"t{i}" for i in range(0, 400, 3)] * 2):
        d = spark.createDataFrame([(x,) for x in done], "task_id string")
        assert ids(remaining_by_filter(tasks, d)) == ids(remaining(tasks, d))


def lines(folder):
    return [json.loads(x) for p in sorted(folder.glob("*.json")) for x in p.read_text().splitlines()]


def test_generation_run(spark, tmp_path, capsys):
    """Shards are scored in two goes, summarised and ranked."""
    tasks = tmp_path / "tasks.jsonl"
    tasks.write_text("".join(json.dumps({"prompt": "p", "groundtruth": f"x = {i};", "metadata": {"task_id": str(i), "repository": f"r{i % 2}"}}) + "\n" for i in range(20)))
    said = tmp_path / "said.jsonl"

    def predict(upto):
        said.write_text("".join(json.dumps({"sample_index": i, "prediction_no_reference": f"x = {i % 5};", "prediction_with_reference": f"x  = {i};", "reference_applied": True, "prompt_extraction_mode_used": "strict", "decode_policy": "greedy"}) + "\n" for i in range(upto)))

    def run(*a):
        code = main([str(x) for x in a], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    predict(10)
    assert run("evaluate", "generation", tasks, said, tmp_path / "run", "--num-shards", 2)[1].startswith("5 records")
    predict(20)
    assert run("evaluate", "generation", tasks, said, tmp_path / "run", "--num-shards", 2)[1].startswith("5 records")  # goes on
    assert run("evaluate", "generation", tasks, said, tmp_path / "run", "--num-shards", 2)[1].startswith("0 records")
    assert run("evaluate", "generation", tasks, said, tmp_path / "run", "--num-shards", 2, "--shard-rank", 1, "--no-resume")[1].startswith("10 records")
    for bad in (("--num-shards", 2, "--shard-rank", 2), ("--limit", 0), ("--split-mod", 3, "--split-rem", 3), ("--split-mod", -1)):
        code, _, err = run("evaluate", "generation", tasks, said, tmp_path / "no", *bad)
        assert code == 1 and err.startswith("error: --")
    assert run("summarise", "generation", tasks, tmp_path / "run", tmp_path / "out", "--num_shards", 2)[0] == 0
    summary = lines(tmp_path / "out/summary")[0]
    assert summary["samples_total"] == 20 and summary["mean_em_no_reference"] == 0.25 and summary["mean_em_with_reference"] == 1.0 and summary["strict_mean_em_with_reference"] == 0.0
    assert len(lines(tmp_path / "out/augmented")) == 20 and [r["sample_index"] for r in lines(tmp_path / "out/per_sample")] == list(range(20))
    assert (tmp_path / "out/summary_by_repository").is_dir()
    code, out, _ = run("calibrate", tmp_path / "rank", f"runs/a={tmp_path}/out/summary", f"runs/b={tmp_path}/out/summary")
    assert code == 0 and out.splitlines()[0].startswith("1. runs/a") and lines(tmp_path / "rank/baseline_calibration_summary")[0]["best"]["rank"] == 1


def test_ppl_run(spark, tmp_path, capsys):
    tasks, said = tmp_path / "tasks.jsonl", tmp_path / "said.jsonl"
    tasks.write_text("".join(json.dumps({"prompt": "p", "groundtruth": "g", "metadata": {"task_id": f"t{i}", "repository": ""}}) + "\n" for i in range(6)))
    said.write_text("".join(json.dumps({"sample_index": i, "logprobs_no_reference": [-1.0, -3.0], "logprobs_with_reference": [-1.0] if i else [], "reference_applied": True, "comparison_status": "ok"}) + "\n" for i in range(6)))
    assert main(["evaluate", "ppl", str(tasks), str(said), str(tmp_path / "run"), "--split-mod", "2", "--split-rem", "0"], spark) == 0
    assert main(["summarise", "ppl", str(tasks), str(tmp_path / "run"), str(tmp_path / "out"), "--num_shards", "1"], spark) == 0
    summary = lines(tmp_path / "out/summary")[0]
    assert summary["samples_total"] == 3 and summary["samples_with_reference_applied"] == 2 and summary["mean_log_ppl_improvement_abs"] == 1.0 and summary["improved_count"] == 2


def test_base_commands(spark, tmp_path, capsys):
    data, home = tmp_path / "data", ["--home", str(tmp_path / "home")]
    data.mkdir()
    with zipfile.ZipFile(data / "repo.zip", "w") as z:
        z.writestr("repo/a.c", "int add(int a, int b) {\n  return a + b;\n}\n")
        z.writestr("repo/b.c", "int sub(int a, int b) {\n  return a - b;\n}\n")
    (data / "bad.zip").write_bytes(b"no archive")

    def run(*a):
        code = main([*home, *map(str, a)], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, err = run("update", "--knowledge_path", data, "--knowledge_base", "t", "--workers", 3)
    assert code == 0 and "repo: 2 files, 2 entries" in out and err.startswith("bad: ")
    (data / "repo.zip").unlink()
    with zipfile.ZipFile(data / "repo.zip", "w") as z:
        z.writestr("repo/c.c", "int mul(int a, int b) {\n  return a * b;\n}\n")
    run("update", "--knowledge_path", data, "--knowledge_base", "t")
    assert "total: 3" in run("stats", "--knowledge_base", "t")[1]
    run("update", "--knowledge_path", data, "--knowledge_base", "t", "--overwrite")
    assert "total: 1" in run("stats", "--knowledge_base", "t")[1]
    assert run("sample", tmp_path / "some", "--knowledge_base", "t", "--n", 5)[0] == 0 and [r["qualified_name"] for r in lines(tmp_path / "some")] == ["mul"]
    tasks = tmp_path / "t.jsonl"
    tasks.write_text('{"prompt": "int mul(int a", "groundtruth": "return a * b;"}\n')
    assert run("batch_retrieve", tasks, tmp_path / "o", "--knowledge_base", "t", "--max", -1, "--batch_size", 10, "--max_workers", 2)[0] == 0
    code, _, err = run("update", "--knowledge_path", tmp_path / "none", "--knowledge_base", "t")
    assert code == 1 and "no such directory" in err
    (data / "x").mkdir()
    (data / "x/y.java").write_text("class Y {}")
    assert KnowledgeBase(spark, str(tmp_path / "home/t")).get_files_by_extension(str(data), [".java", ".zip"]) == [f"{data}/bad.zip", f"{data}/repo.zip", f"{data}/x/y.java"]


def test_exports():
    for name in codeloom.__all__:
        assert getattr(codeloom, name) is not None
