"""Ingest, the stored table, scans, the facade and the command line."""

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom import KNOWLEDGE, KnowledgeBase, KnowledgeTable, by_ids, scan, search, stats, upsert
from codeloom.cli import main
from codeloom.config import load_languages
from codeloom.operators.ingest import extract, structure_fp, syntax_ok
from codeloom.operators.scan import candidates, stats_dict
from codeloom.schema import check_columns
from codeloom.sources.files import read_archives, read_directory, read_shards, read_tasks, sample, write_json

HELLO = '#include <stdio.h>\n\n/* says hello */\nint main(void) {\n    printf("hello");\n    return 0;\n}\n'
UTIL = "int add(int a, int b) {\n    return a + b;\n}\n\nchar *my_strdup(const char *s) {\n    char *p = malloc(10);\n    return p;\n}\n"


@pytest.fixture
def kb(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    counts = base.update_from_sources(base.sources([("repo", "hello.c", HELLO), ("repo", "util.c", UTIL), ("repo", "A.java", "class A {\n  void f() {}\n}\n"), ("repo", "x.txt", "no")])).first()
    assert (counts.files, counts.entries, counts.distinct_entries, counts.errors) == (4, 5, 5, 0)
    return base


def test_facade(spark, kb):
    assert kb.stats() == {"total": 5, "by_language": {"C": 3, "Java": 2}, "by_repository": {"repo": 5}, "by_kind": {"function": 3, "type": 1, "method": 1}}
    assert [r.qualified_name for r in kb.search("PRINTF").collect()] == ["main"] and kb.search("%").count() == 0
    assert kb.search("malloc", kind="function").first().qualified_name == "my_strdup" and kb.search("", shots=2).count() == 2 and kb.search("", shots=0).count() == 5
    found = kb.information_retrieve(["my_strdup const char", "", "***"], shots=1).collect()
    assert [(r.query_id, r.qualified_name) for r in found] == [(0, "my_strdup")]
    row = kb.knowledge_retrieve(["int plus(int x, int y) {\n    return x + y;\n}"], "C", shots=1).first()
    assert row.qualified_name == "add" and 0.5 < row.containment < 1
    assert kb.knowledge_retrieve([""], "C", shots=2).count() == 2 and kb.knowledge_retrieve(["x"], "Perl").count() == 0


def test_upsert_keeps_ids_and_last_wins(spark, kb):
    before = {r.qualified_name: r.id for r in kb.load().collect()}
    edited = kb.sources([("repo", "util.c", UTIL.replace("a + b", "b + a")), ("new", "z.c", "int z;\n")])
    kb.update(kb.ingest(edited))
    rows = kb.load().collect()
    after = {r.qualified_name: r for r in rows}
    assert after["add"].id == before["add"] and "b + a" in after["add"].text and after["global::z"].id > max(before.values()) and len(rows) == 6
    assert kb.update(kb.ingest(kb.sources([("new", "empty.c", " ")]))) is None
    kb.update(kb.ingest(kb.sources([("repo", "util.c", "int add(int a, int b) {\n    return 1;\n}\n")])), replace=True)
    assert "my_strdup" not in {r.qualified_name for r in kb.load().collect()}
    kb.table.drop_old()
    assert kb.load().count() == 5
    assert len({r.created_at for r in rows if r.qualified_name in ("add", "global::z")}) == 1


def test_duplicate_keys_in_one_batch(spark):
    empty = spark.createDataFrame([], KNOWLEDGE)
    names = [f for f in KNOWLEDGE.names if f not in ("id", "created_at")]
    row = ("r", "p", ".c", "C", "function", "n", "f", "f", None, 1, 3)
    batch = spark.createDataFrame([(*row, t, None, None, i) for i, t in enumerate(["old", "mid", "new"])], ", ".join(f"{n} {KNOWLEDGE[n].dataType.simpleString()}" for n in names) + ", position int")
    out = upsert(empty, batch, "position").collect()
    assert [(r.id, r.text) for r in out] == [(1, "new")]


def test_scans(spark, kb):
    t = kb.load()
    assert scan(t, language="C", limit=2).count() == 2 and scan(t, limit=0).count() == scan(t, limit=-1).count() == 5 and scan(t, language="").count() == 0
    assert by_ids(t, []).count() == 0 and by_ids(t, [1, 99999]).count() == 1
    assert candidates(t, []).count() == 5 and candidates(t, ["C", "Java"]).count() == 5 and candidates(t, ["Perl"]).count() == 0
    assert "text" not in candidates(t).columns and "text" in candidates(t, include_text=True).columns
    with pytest.raises(RuntimeError):
        check_columns(t.drop("kind"))
    check_columns(t.withColumn("more", t.id))
    plan = search(t, "x", language="C")._jdf.queryExecution().executedPlan().toString()
    assert "structure_fingerprint" not in plan.split("Scan")[-1]
    nulls = t.withColumn("language", t.language.substr(9, 1))
    assert stats(nulls).where("dimension = 'language' and value = ''").count() == 1 and sample(t, 3).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "src/in").mkdir(parents=True)
    (tmp_path / "src/in/a.c").write_bytes(b"int a;\r\nint b\xff;\n")
    (tmp_path / "src/b.H").write_text("int c;")
    (tmp_path / "src/c.md").write_text("int d;")
    rows = read_directory(spark, str(tmp_path / "src"), "r").collect()
    assert [(r.repository, r.relative_path, r.language, r.content) for r in rows] == [("r", "in/a.c", "C", "int a;\nint b;\n")]
    with zipfile.ZipFile(tmp_path / "repo.zip", "w") as z:
        z.writestr("repo-main/src/a.c", HELLO)
        z.writestr("b.java", "class B {}")
        z.writestr("repo-main/no.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    rows = {(r.repository, r.relative_path): r for r in read_archives(spark, str(tmp_path)).collect()}
    assert set(rows) == {("repo", "src/a.c"), ("repo", "b.java"), ("bad", None)} and rows[("bad", None)].error
    deep = extract(spark.createDataFrame([("r", "d.c", ".c", "C", "int f() {" + "{" * 30000)], "repository string, relative_path string, file_extension string, language string, content string"))
    rows = deep.collect()
    assert len(rows) >= 1 and all((r.error is None) != (r.kind is None) for r in rows)  # units, or one row with the error
    both = extract(spark.createDataFrame([("r", "d.c", ".c", "C", "int f() {" + "{" * 30000), ("r", "e.c", ".c", "C", "int g(int a) {\n  return a;\n}\n")], "repository string, relative_path string, file_extension string, language string, content string"))
    assert [r.qualified_name for r in both.where("relative_path = 'e.c'").collect()] == ["g"]
    nested = spark.createDataFrame([("int f() " + "{" * 3000, "C"), ("int a;", "C")], "c string, l string").select(structure_fp("c", "l").alias("f"), syntax_ok("c", "l").alias("ok")).collect()
    assert nested[1].f and nested[1].ok and nested[0].ok is False


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    """A run of members each, found by the directory alone; other members, were they broken, are not touched."""
    texts = {f"repo-main/d{i % 7}/f{i}.c": f"int f{i}() {{ return {i}; }}\n" * (i % 50 + 1) for i in range(1000)}
    with zipfile.ZipFile(tmp_path / "repo.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, text) in enumerate(texts.items()):
            z.writestr(name, text, zipfile.ZIP_STORED if i % 3 else None)
            z.writestr(name + ".bin", bytes(2000), zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "repo.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "repo.zip") as z:
        broken = z.getinfo("repo-main/d5/f5.c")
        for m in z.infolist():
            if m.filename.endswith(".bin"):
                raw[m.header_offset : m.header_offset + 4] = b"XXXX"  # no one looks here
    raw[broken.header_offset + 30 + len(broken.filename) + 3] ^= 1
    (tmp_path / "repo.zip").write_bytes(raw)
    df = read_archives(spark, str(tmp_path), partitionFiles=100)
    assert df.rdd.getNumPartitions() == 10 and read_archives(spark, str(tmp_path), partitionBytes=20_000).rdd.getNumPartitions() > 10
    rows = df.collect()
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and "d5/f5.c" in bad[0].error and bad[0].relative_path is None
    assert {f"repo-main/{r.relative_path}": r.content for r in rows if not r.error} == {k: v for k, v in texts.items() if k != "repo-main/d5/f5.c"}
    assert {(r.repository, r.language, r.file_extension) for r in rows if not r.error} == {("repo", "C", ".c")}


def test_trees_are_listed_before_they_are_read(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"t/s{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"t/s{i % 3}/f{i}.java").write_text(f"class F{i} {{}}")
        (tmp_path / f"t/s{i % 3}/f{i}.dat").write_bytes(bytes(100))
        (tmp_path / f"t/s{i % 3}/f{i}.dat").chmod(0)
    df = read_directory(spark, f"file://{tmp_path}/t", "r", partitionFiles=7)
    assert df.rdd.getNumPartitions() == 5 and {r.relative_path for r in df.collect()} == {f"s{i % 3}/f{i}.java" for i in range(30)}
    (tmp_path / "none").mkdir()
    assert read_directory(spark, str(tmp_path / "none")).count() == 0 == read_archives(spark, str(tmp_path / "none")).count()


def test_udfs(spark):
    df = spark.createDataFrame([("int a;", "C"), (None, "C"), ("(", "C"), ("x", "Perl")], "c string, l string").coalesce(1)
    got = [tuple(r) for r in df.select(structure_fp("c", "l"), syntax_ok("c", "l")).collect()]
    assert got[0][0] and got[0][1] and got[1] == (None, True) and got[2][1] is False and got[3] == (None, True)


def test_config(tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"languages": [{"name": "X", "extensions": [".x"]}]}')
    bad.write_text("{}")
    assert load_languages(str(good)) == {"X": [".x"]}
    with pytest.raises(KeyError):
        load_languages(str(bad))
    with pytest.raises(FileNotFoundError):
        load_languages(str(tmp_path / "none.json"))


def test_command_line(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "repo.zip", "w") as z:
        z.writestr("repo/hello.c", HELLO)
        z.writestr("repo/util.c", UTIL)
    home = ["--home", str(tmp_path / "home")]
    run = lambda *a: (main([*home, *a], spark), capsys.readouterr().out)
    assert run("update", "--knowledge_path", str(tmp_path), "--knowledge_base", "t")[0] == 0
    assert "total: 3" in run("stats", "--knowledge_base", "t")[1]
    assert "main" in run("search", "printf", "--knowledge_base", "t")[1] and "my_strdup" in run("search", "malloc", "--kind", "function", "--knowledge_base", "t")[1]
    q = tmp_path / "q.c"
    q.write_text("int add(int a, int b) {\n    return a + b;\n}\n")
    assert "add" in run("knowledge_retrieve", str(q), "--knowledge_base", "t", "--shots", "1")[1]
    assert "add" in run("information_retrieve", str(q), "--knowledge_base", "t", "--shots", "1")[1]
    assert run("update", "--knowledge_path", str(tmp_path / "no"), "--knowledge_base", "t")[0] == 1 and main(home, spark) == 1
    tasks = tmp_path / "t.jsonl"
    tasks.write_text('{"prompt": "int add(int a", "groundtruth": "return a + b;", "metadata": {"task_id": "x"}}\n\n{"prompt": "", "groundtruth": "zzz"}\n')
    code, out = run("batch_retrieve", str(tasks), str(tmp_path / "out"), "--knowledge_base", "t")
    assert code == 0 and "0.5000 (1 of 2)" in out
    assert [r.sample_index for r in read_tasks(spark, str(tasks)).orderBy("sample_index").collect()] == [0, 1] and read_tasks(spark, str(tasks), 1).count() == 1


def test_shards(spark, tmp_path):
    for r in range(2):
        (tmp_path / f"per_sample.rank{r}.jsonl").write_text(f'{{"sample_index": {r}, "task_id": "t{r}"}}\n')
    assert read_shards(spark, str(tmp_path), 2).count() == 2
    with pytest.raises(FileNotFoundError):
        read_shards(spark, str(tmp_path), 3)
    write_json(read_shards(spark, str(tmp_path), 2), str(tmp_path / "o"), ["sample_index"], one_file=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_streaming_ingest(spark, tmp_path):
    from codeloom.streaming.ingest import stream_ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text(UTIL)
    table = KnowledgeTable(spark, str(tmp_path / "kb"))
    stream_ingest(spark, str(tmp_path / "in"), table, str(tmp_path / "ck"), "r").awaitTermination()
    assert stats_dict(stats(table.load()))["total"] == 2
    (tmp_path / "in/b.c").write_text("int only;\n")
    stream_ingest(spark, str(tmp_path / "in"), table, str(tmp_path / "ck"), "r").awaitTermination()
    assert stats_dict(stats(table.load()))["total"] == 3


def test_filters_hold_the_windows_of_every_text(spark, tmp_path):
    """Windows are told apart once a file and batch, so units inside others add no rows; their hashes are those that a keyword is looked up by."""
    from codeloom.operators import grams

    texts = ["ABCabc", "int f() { return 1; }" * 3, "x", "", None, "ab", "Ünï🙂c🙂🙂o", "a\x00b\nc", "return 1; }"]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/data")
    grams.write_filters(spark, f"{tmp_path}/data", f"{tmp_path}/filters")
    windows = [r for b in grams._distinct_windows(iter([pa.RecordBatch.from_pydict({"file": ["f"] * len(texts), "text": texts})])) for r in b.column(1).to_pylist()]
    assert len(windows) == len(set(windows))
    got = {r.x for r in spark.createDataFrame([(w,) for w in windows], "w string").select(F.explode(grams.gram_hashes("w")).alias("x")).collect()}
    want = {r.x for r in spark.createDataFrame([(t,) for t in texts], "text string").select(F.explode(grams.gram_hashes("text")).alias("x")).collect()}
    assert got == want
    filters = spark.read.schema(grams.FILTER).parquet(f"{tmp_path}/filters")
    assert all(not grams.files_without(filters, k).count() for k in ("abcABC", "🙂C🙂", "a\x00B\n", "RETURN 1"))
    assert grams.files_without(filters, "zzzq").count() == 1
