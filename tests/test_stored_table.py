"""The stored table: which files an upsert touches, writers at once, and what is kept beside the units."""

import glob
import hashlib
import json
import os
import random

import pyarrow as pa
import pytest

from codeloom import KNOWLEDGE, KnowledgeTable, search, stats
from codeloom.functions import packed as packed_functions
from codeloom.functions.packed import packed_ngrams, signed_postings
from codeloom.functions.text import ngram_fingerprint, packed
from codeloom.operators import grams
from codeloom.operators import index as index_module
from codeloom.operators import retrieve as R
from codeloom.operators import store
from codeloom.operators.scan import stats_dict
from codeloom.schema import RECORD

ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD)


def record(repo, path, name, text, kind="function", language="C", line=1):
    return (repo, path, ".c", language, kind, "n", name, name, None, line, line + 3, text, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("text_fingerprint", ngram_fingerprint("text")).withColumn("structure_fingerprint", ngram_fingerprint("text", 3))


def small(spark, path, **kw):
    return KnowledgeTable(spark, str(path), **{"buckets": 4, "index_buckets": 4, **kw})


def files(path, top):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/{top}/**/*.parquet", recursive=True)}


def plain(table):
    return sorted((r.id, r.repository, r.relative_path, r.qualified_name, r.text) for r in table.load().collect())


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def test_an_upsert_leaves_other_files_alone(spark, tmp_path):
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, [record("r", f"p{i}", f"f{i}", f"int f{i} ( )") for i in range(40)]))
    before, first = kb.manifest(), files(tmp_path, "data")
    ids = {r.qualified_name: r.id for r in kb.load().collect()}
    assert sorted(ids.values()) == list(range(1, 41)) and [n for n, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(ids)  # in key order
    kb.upsert(frame(spark, [record("r", "p7", "f7", "int changed ( )"), record("r", "p7", "g7", "int more ( )", line=9)]))
    after = kb.manifest()
    changed = {b for b in after["data"] if after["data"][b] != before["data"].get(b)}
    assert len(changed) == 1 and first <= files(tmp_path, "data")
    now = {r.qualified_name: (r.id, r.text) for r in kb.load().collect()}
    assert now["f7"] == (ids["f7"], "int changed ( )") and now["g7"][0] == 41 and len(now) == 41
    assert plain(kb)[0] in plain(kb) and kb.load(f"{before['version']:08d}.json").count() == 40  # readers of the older version still read it
    kb.drop_old()
    assert kb.load().count() == 41 and len(kb._names("_versions")) == 1 and not first <= files(tmp_path, "data")


def test_the_second_of_two_writers_begins_again(spark, tmp_path, monkeypatch):
    one, two = small(spark, tmp_path), small(spark, tmp_path)
    one.upsert(frame(spark, [record("r", "a", "a", "int a")]))
    tries = []
    put = one._put

    def late(batch, base, replace):
        tries.append(base["version"])
        if len(tries) == 1:
            two.upsert(frame(spark, [record("r", "b", "b", "int b"), record("r", "a", "a", "int theirs")]))
        return put(batch, base, replace)

    monkeypatch.setattr(one, "_put", late)
    one.upsert(frame(spark, [record("r", "c", "c", "int c")]))
    assert tries == [1, 2] and sorted(r.text for r in one.load().collect()) == ["int b", "int c", "int theirs"]
    assert len({r.id for r in one.load().collect()}) == 3 and one.manifest()["version"] == 3
    assert {f.split("/")[1] for f in files(tmp_path, "data")} <= {f.split("/")[1] for v in one._names("_versions") for f in one.manifest(v)["data"].values()}  # nothing of the lost try is left


@pytest.mark.parametrize("local", [True, False])
def test_a_version_is_made_once(spark, tmp_path, local, monkeypatch):
    kb = small(spark, tmp_path)
    if not local:
        monkeypatch.setattr(kb, "_fs", type("Fs", (), {"__getattr__": lambda s, n: getattr(kb_fs, n), "getUri": lambda s: Uri()})())
        kb_fs, Uri = KnowledgeTable(spark, str(tmp_path))._fs, type("Uri", (), {"getScheme": lambda s: "other"})
        monkeypatch.setattr(kb, "_rename", lambda a, t: renamed(kb_fs, spark, a, t))
    kb._publish('{"version": 1}', "00000001.json")
    with pytest.raises(store.Conflict):
        kb._publish('{"version": 2}', "00000001.json")
    assert json.loads((tmp_path / "_versions/00000001.json").read_text()) == {"version": 1} and not kb._names("_aside")


def renamed(fs, spark, aside, target):
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(aside, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))


def test_replace_drops_units_of_edited_files_only(spark, tmp_path):
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, [record("r", "a", "x", "int x"), record("r", "a", "y", "int y", line=9), record("r", "b", "z", "int z"), record(None, "a", "n", "int n")]))
    kb.upsert(frame(spark, [record("r", "a", "x", "int x2")]), replace=True)
    assert sorted(r.text for r in kb.load().collect()) == ["int n", "int x2", "int z"]
    kb.upsert(frame(spark, [record(None, "a", "m", "int m")]), replace=True)
    assert sorted(r.text for r in kb.load().collect()) == ["int m", "int x2", "int z"]
    assert stats_dict(kb.stats()) == stats_dict(stats(kb.load())) and kb.upsert(frame(spark, []), replace=True) is None


WORDS = [f"w{i}" for i in range(30)]


def some_rows(rng, n, files_=12):
    out = {}
    for _ in range(n):
        path, name = f"p{rng.randrange(files_)}", f"f{rng.randrange(4)}"
        out[path, name] = record(f"r{int(path[1:]) % 2}", path, name, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), language=rng.choice(["C", "Java"]))
    return list(out.values())


def results(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9), round(r.containment, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory, rng):
    """Ten upserts, some of which replace files; indexes and counts are folded on the way."""
    path = tmp_path_factory.mktemp("grown")
    kb = small(spark, path)
    for i in range(10):
        kb.upsert(frame(spark, some_rows(rng, 25 if i else 40)), replace=i % 3 == 2)
    return kb


def test_the_index_equals_the_units(spark, grown, rng):
    q = spark.createDataFrame([(i, [" ".join(rng.choice(WORDS) for _ in range(9))][0]) for i in range(12)] + [(99, "nothing here")], "query_id long, text string")
    for column, n, k, scope in (("text_fingerprint", 2, -1, {}), ("text_fingerprint", 2, 4, {"language": ["C", "Perl"], "repository": "r1"}), ("structure_fingerprint", 3, 4, {"language": "C"})):
        asked = q.select("query_id", ngram_fingerprint("text", n).alias("fingerprint"))
        assert 1 <= len(grown.manifest()["segments"][column]) <= store.SEGMENTS
        want = results(R.retrieve(asked, grown.load(), column, 3, max_candidates=k, **scope))
        assert results(R.retrieve(asked, grown.index(column, **scope), column, 3, max_candidates=k)) == want and want


def test_a_retrieval_reads_the_asked_buckets_only(spark, grown):
    index = grown.index("text_fingerprint")
    asked = spark.createDataFrame([(0, "w1 w2")], "query_id long, text string").select("query_id", ngram_fingerprint("text")[0].alias("h"))
    folders = index.folders(asked)
    every = [f for s in index.segments for f in glob.glob(f"{s}/postings/bucket=*")]
    assert 0 < len(folders) <= len(index.segments) < len(every)
    hits = index.hits(asked, True)
    assert {os.path.dirname(f.removeprefix("file://").removeprefix("file:")) for f in hits.inputFiles()} <= set(folders)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Scan parquet" in plan


def test_stats_of_many_upserts_read_no_unit(spark, grown):
    kept = grown.stats()
    assert stats_dict(kept) == stats_dict(stats(grown.load())) and stats_dict(kept)["total"] == grown.load().count()
    assert all("/counts/" in f for f in kept.inputFiles()) and len(grown.manifest()["counts"]) <= store.SEGMENTS


def test_search_opens_only_files_that_can_match(spark, grown, tmp_path):
    t = grown.load()
    for keyword in ("W1 w2", "w29", "w", "", "zzz", "%", "w1 w2 w3 w4"):
        want = sorted(r.id for r in search(t, keyword).collect())
        assert sorted(r.id for r in grown.search(keyword).collect()) == want, keyword
    kb = small(spark, tmp_path, buckets=16)
    kb.upsert(frame(spark, [record("r", f"p{i}", f"f{i}", f"common words Rare{i:04d}x🙂 und Straße") for i in range(300)]))
    opened = kb._holding("RARE0123X").inputFiles()
    assert len(opened) <= 4 < 12 < len(kb.load().inputFiles()) and [r.qualified_name for r in kb.search("rare0123x").collect()] == ["f123"]
    assert kb._holding("common").inputFiles() and kb.search("COMMON", shots=5).count() == 5 and kb.search("x🙂 U").count() == 300 and kb.search("STRAßE").count() == 300
    assert kb.search("STRASSE").count() == 0 == len(kb._holding("nowhere at all").inputFiles())


def test_frequent_fingerprints_are_probed_for_live_candidates(spark, tmp_path, monkeypatch):
    """One fingerprint is in every unit: queries with it get their first k without its postings being counted."""
    monkeypatch.setattr(index_module, "FREQUENT", 200)
    rng = random.Random(4)
    rows = [record("r", f"p{i}", f"f{i}", "every unit " + " ".join(f"x{rng.randrange(700)} y{rng.randrange(700)}" for _ in range(4)) + (" hot pair" if i % 3 == 0 else "")) for i in range(1500)]
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, rows))
    texts = [r[11] for r in rows[:40]] + ["every unit", "every unit hot pair x1 y1", "none at all"]
    wanted = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").select("query_id", ngram_fingerprint("text").alias("want")).where("want is not null").localCheckpoint()
    pick = lambda df: sorted((r.query_id, r.rk, r.t.id, r.n) for r in df.collect())
    index = kb.index("text_fingerprint")
    common = index.frequent(R._asked(wanted)).collect()
    assert max(r.n for r in common) == 1500 and len(common) >= 2
    bounded = pick(R.overlaps(wanted, index, 1))
    monkeypatch.setattr(index, "frequent", lambda asked: None)
    assert pick(R.overlaps(wanted, index, 1)) == bounded
    # of the queries whose bound holds, pairs that are counted, against all pairs that share anything
    closed = wanted.where("query_id < 40")
    asked = R._asked(closed)
    every = R._counted(index.hits(asked, True)).count()
    told = spark.createDataFrame([(r.h,) for r in common], "h string")
    rare = R._counted(index.hits(asked.join(told, "h", "left_anti"), True)).count()
    assert 10 * rare < every


def test_an_upsert_leaves_no_copy_of_texts_beside_the_table(spark, tmp_path):
    """Texts and fingerprints are written aside once, as 8 bytes a value, and dropped when the version is there."""
    import pyarrow.parquet as pq

    from codeloom.tables import shared_folder

    at = shared_folder(spark).removeprefix("file://")
    held = lambda: {f for f in glob.glob(f"{at}/*/*.parquet") if {"text", "text_fingerprint"} & set(pq.read_schema(f).names)}
    before = held()
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, [record("r", f"p{i}", "f", f"int f{i} ( )") for i in range(20)]))
    kb.upsert(frame(spark, [record("r", f"p{i}", "f", f"int g{i} ( )") for i in range(10)]))
    assert held() <= before and kb.load().count() == 20


def test_fingerprints_are_packed_and_told_again(spark):
    from codeloom.functions.text import packed, unpacked

    rows = [["0123456789abcdef", "ffffffffffffffff", "0000000000000000"], [], None, ["0123456789ABCDEF"], ["a"], ["0123456789abcde", "0123456789abcdef0"], ["0123456789abcdef", None]]
    got = [(r.n, r.back) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, fp array<string>").select("i", packed("fp").alias("p")).selectExpr("i", "p").select("i", (unpacked("p")).alias("back"), "p").selectExpr("i", "octet_length(p) n", "back").orderBy("i").collect()]
    assert got == [(24, rows[0]), (0, []), *[(None, None)] * 5]


def test_write_makes_a_version_of_just_these(spark, tmp_path):
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, [record("r", "a", "a", "int a"), record("r", "b", "b", "int b")]))
    kb.write(kb.load().where("qualified_name = 'b'"))
    assert [r.qualified_name for r in kb.load().collect()] == ["b"] and stats_dict(kb.stats())["total"] == 1
    kb.upsert(frame(spark, [record("r", "c", "c", "int c")]))
    assert sorted(r.id for r in kb.load().collect()) == [2, 3] and kb.search("int a").count() == 0


def test_empty_tables(spark, tmp_path):
    kb = small(spark, tmp_path)
    assert kb.load().count() == 0 and kb.load().columns == KNOWLEDGE.names and kb.search("abc").count() == 0 and kb.version() is None
    q = spark.createDataFrame([(0, ["a"])], "query_id long, fingerprint array<string>")
    assert R.retrieve(q, kb.index("text_fingerprint"), shots=2).count() == 0 and stats_dict(kb.stats())["total"] == 0


def test_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """What is too much to be broadcast isn't broadcast by Spark either, whose estimate goes by the size of files."""
    kb = small(spark, tmp_path)
    kb.upsert(frame(spark, [record("r", f"p{i}", f"f{i}", f"int f{i} ( )") for i in range(40)]))
    plans = []
    commit = kb._commit

    def seen(m, rows, gained, *more):
        plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in (rows, *gained.values()))
        return commit(m, rows, gained, *more)

    monkeypatch.setattr(kb, "_commit", seen)
    monkeypatch.setattr(store, "few", lambda *a: False)
    kb.upsert(frame(spark, [record("r", f"p{i}", f"f{i}", "int changed ( )") for i in range(30)]), replace=True)
    assert len(plans) == 3 and not [p for p in plans if "Broadcast" in p]
    assert kb.load().count() == 40 and kb.load().where("text = 'int changed ( )'").count() == 30


def test_packed_fingerprints_are_told_in_batches(spark, monkeypatch):
    """packed_ngrams() is the packed form of ngram_fingerprint()."""
    texts = ["one", "two words", "a b a b a b", "", None, "!!! ...", "é1 2_3 _ __ z", "a\x00b c\x00d", *(" ".join(f"w{(i * k) % 97}" for k in range(400)) for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    for n in (2, 3):
        both = df.select("text", packed_ngrams("text", n).alias("a"), packed(ngram_fingerprint("text", n)).alias("b"))
        assert [r.text for r in both.collect() if r.a != r.b] == [] and both.where("a is null").count() == 3
    for size in (1, 54, 55, 56, 63, 64, 65, 200):  # of a gram, about the end of md5's block
        assert packed_functions._packed_of([b"ab", b"x" * (size - 3) + b" yz" if size > 3 else b"x", None, b""], 2)[:2] == [hashlib.md5(t).digest()[:8] for t in (b"ab", b"x" * (size - 3) + b" yz" if size > 3 else b"x")]
    told = [t.encode() if t is not None else None for t in texts]
    monkeypatch.setattr(packed_functions, "TEXTS", 30)
    monkeypatch.setattr(packed_functions, "GRAMS", 7)
    assert list(packed_functions._all_packed(told, 2)) == [x for t in told for x in packed_functions._packed_of([t], 2)]


def test_postings_are_what_is_gained_and_lost(spark):
    value = lambda c: c * 8
    odd = ["x", "0" * 16, "A" * 16]
    rows = [
        (1, "C", "r", None, value(b"a") + value(b"b") + value(b"a"), "C", "r", None, value(b"b") + value(b"c"), True),
        (2, "C", "r", None, value(b"a") + value(b"b"), "C", "q", None, value(b"b"), False),
        (3, "C", "r", None, value(b"d") * 3, None, None, None, None, False),
        (4, "C", "r", odd, None, "C", "r", None, bytes(8) + value(b"e"), True),
        (5, "C", "r", None, None, "C", "r", None, None, True),
        (6, "C", "r", None, b"", "C", "r", None, value(b"f"), True),
    ]
    units = spark.createDataFrame(rows, "id long, language string, repository string, now array<string>, now_ binary, was_language string, was_repository string, had array<string>, had_ binary, still boolean").coalesce(1)
    got = sorted((r.id, r.sign, bytes(r.h), r.language, r.repository) for r in signed_postings(units).collect())
    want = [(1, 1, value(b"a"), "C", "r"), (1, -1, value(b"c"), "C", "r"), (2, 1, value(b"a"), "C", "r"), (2, 1, value(b"b"), "C", "r"), (2, -1, value(b"b"), "C", "q"), (3, 1, value(b"d"), "C", "r")]
    want += [(4, 1, bytes(9) + b"x", "C", "r"), (4, 1, bytes(9) + b"A" * 16, "C", "r"), (4, -1, value(b"e"), "C", "r"), (6, -1, value(b"f"), "C", "r")]
    assert got == sorted(want)


def test_windows_of_latin_and_other_texts(monkeypatch):
    """Each window of a file's texts, none over the end of a text, by sorting or by a map."""
    texts = ["Abc aBC", "ab", "naïve ÀÉ", "日本語 abc", "🙂xy z", None, "", "ÿþA" * 50, "the end"]
    want = {(f"f{i % 2}", "".join(c.lower() if "A" <= c <= "Z" else c for c in t[k : k + 3])) for i, t in enumerate(texts) if t for k in range(len(t) - 2)}
    batch = pa.RecordBatch.from_pydict({"file": [f"f{i % 2}" for i in range(len(texts))], "text": texts})
    for few, stretch in ((1 << 17, 1 << 19), (0, 1 << 19), (0, 5)):
        monkeypatch.setattr(grams, "FEW", few)
        monkeypatch.setattr(grams, "STRETCH", stretch)
        got = [w for b in grams._distinct_windows(iter([batch])) for w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert set(got) == want


def test_earlier_files_without_packed_fingerprints_are_read(spark, tmp_path):
    """Units of files that hold arrays only, beside such with packed ones, load and take part in upserts."""
    kb = small(spark, tmp_path, buckets=1)
    kb.upsert(frame(spark, [record("r", f"p{i}", f"f{i}", f"int f{i} ( )") for i in range(5)]))
    before = {r.id: (r.text_fingerprint, r.structure_fingerprint) for r in kb.load().collect()}
    at = f"{tmp_path}/{next(iter(kb.manifest()['data'].values()))}"
    old = kb.load().localCheckpoint()
    old.write.mode("overwrite").parquet(at)
    assert {r.id: (r.text_fingerprint, r.structure_fingerprint) for r in kb.load().collect()} == before and all(a and b for a, b in before.values())
    kb.upsert(frame(spark, [record("r", "p1", "f1", "int other ( )")]))
    after = {r.id: (r.text_fingerprint, r.structure_fingerprint) for r in kb.load().collect()}
    assert len(after) == 5 and sorted(i for i in after if after[i] != before[i]) == [2]
    asked = spark.createDataFrame([(0, "int f3 ( )")], "query_id long, text string").select("query_id", ngram_fingerprint("text").alias("fingerprint"))
    assert [r.qualified_name for r in R.retrieve(asked, kb.index("text_fingerprint"), "text_fingerprint", 1).collect()] == ["f3"]
