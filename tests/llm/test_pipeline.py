"""The pipeline's stages, each held against a plain version on its own input."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from codeloom.llm.common import saved, table  # noqa: E402

from test_operators import BPE, ODD, base_spans, contamination_model, near_model  # noqa: E402


def test_stages(spark, sf_dir):
    import sentencepiece

    docs = table(spark, sf_dir, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)
    docs = saved(P.drop_toxic(spark, docs, sf_dir))
    assert docs.columns == P.COLUMNS
    kept = texts(docs)
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    right = [(i in kept) != bool(y) for i, y in toxic.items() if i in before]
    assert sum(right) >= 0.9 * len(right) and all(kept[i] == before[i] for i in kept)

    docs = saved(P.drop_near_duplicates(spark, docs, sf_dir))
    assert set(texts(docs)) == {i for i, (_, _, first) in near_model(kept.items(), 80).items() if first}

    before, docs = texts(docs), saved(P.drop_contaminated(spark, docs, sf_dir))
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(texts(docs)) == {i for i, *_, bad in contamination_model(before.items(), items) if not bad}

    before, docs = texts(docs), saved(P.redact_secrets(spark, docs, sf_dir))
    after = texts(docs)
    assert set(after) == set(before) and not any(base_spans(t) for t in after.values())
    for i, t in before.items():
        if "[secret]" not in after[i]:
            assert after[i] == t
        else:
            assert re.fullmatch(".*".join(map(re.escape, after[i].split("[secret]"))), t, re.S)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    sp = sentencepiece.SentencePieceProcessor(model_file=BPE)
    rows = P.encode_pieces(spark, docs, sf_dir).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: sp.encode(t) for i, t in after.items()} and all(r.round_trip for r in rows)


ROWS = [(i, t) for i, t in ODD if len(t or "") < 60_000] + [(20, "password=abcdefghijkl1 tail"), (20, "other words under the id"), (20, "password=abcdefghijkl1 tail"), (None, "no id, same text here"), (None, None), (None, "")]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, name):
    """Nulls, empty and long texts, repeated rows and ids, no rows, and a table of its own column names only."""
    stage = dict(P.STAGES)[name]
    docs = spark.createDataFrame([(i, t, None, "src", None) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = stage(spark, docs, sf_dir).collect()
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    rows = sorted((str(r.doc_id), str(r.text)) for r in got) if name != "sentencepiece" else []
    every = sorted((str(i), str(t)) for i, t in ROWS)
    if name == "near_duplicates":
        kept = [i for i, _ in rows if i != "None"]
        assert len(kept) == len(set(kept)) and sum(i == "None" for i, _ in rows) == 3 and "20" in kept and "7" not in kept and set(rows) <= set(every)
    elif name == "secrets":
        assert [i for i, _ in rows] == [i for i, _ in every]
        assert sorted(t for i, t in rows if i == "20") == ["[secret] tail", "[secret] tail", "other words under the id"]
    elif name == "sentencepiece":
        assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    else:
        assert rows == every
