"""Every query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from codeloom.plans import more_oracles, more_queries, oracles, queries, stored_queries

ORACLES = oracles.ORACLES | more_oracles.ORACLES | stored_queries.ORACLES
QUERIES = queries.QUERIES | more_queries.QUERIES | stored_queries.QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_turns(spark, tmp_path):
    """The queries without SQL run over every pair of turns; distances count code points."""
    texts = ["plain", "pläin", "日本語 text", "日本 text", "🙂🙂", "", "Ünï\nsecond", "plain"]
    turns = [(c, t, texts[(c + t) % len(texts)]) for c in range(20) for t in range(1, 5)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {(c, t): x for c, t, x in turns}
    pairs = {c * 100 + t: (said[c, t - 1], x) for (c, t), x in said.items() if t > 1}
    want = {}
    for n, (a, b) in pairs.items():
        a, b = a.split("\n")[0], b.split("\n")[0]
        if n % 11:
            want[n] = 1 - distance(a, b) / max(len(a), len(b), 1)
    run = lambda name: entry.queries()[f"{name}_all_turns"](spark, str(tmp_path)).collect()
    got = {r.sample_index: r.es for r in run("edit_similarity")}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    scored = {r.sample_index: r.strict_es_no_reference for r in run("score_records")}
    assert set(scored) == set(pairs) and all(abs(scored[n] - want[n]) < 2e-9 for n in want)
    assert [r.samples_total for r in run("summary_overall")] == [len(pairs)]
    assert sum(r.samples for r in run("summary_by_repository")) == sum(r.samples_total for r in run("shard_summaries")) == len(pairs)


def test_upsert_takes_every_document(spark, sf_dir, db):
    ids = {i for (i,) in db.execute("SELECT doc_id FROM documents").fetchall()}
    got = entry.queries()["upsert_whole_table"](spark, sf_dir).collect()
    want = {(f"doc_{i}", None if i % 3 == 0 else "change 1") for i in ids} | {(f"new_doc_{i}", "change 1") for i in ids if i % 3 == 0}
    assert {(r.qualified_name, r.new_text) for r in got} == want and len({r.id for r in got}) == len(got) == len(want)


def test_fingerprints_of_texts_without_words(spark, tmp_path):
    """Texts without words, empty ones and nulls count -1, as the SQL has it."""
    texts = ["one", "two words", "three small words", "", None, "!!! ...", "äöü ß", "a\x00b c", "é1 2_3 _ __ z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries.text_fingerprint(spark, str(tmp_path)).toPandas(), c.execute(ORACLES["text_fingerprint"]).fetchdf()
    assert rows(got) == rows(want) and list(got.set_index("doc_id").loc[[3, 4, 5], "n"]) == [-1, -1, -1]
