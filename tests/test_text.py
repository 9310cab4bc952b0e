"""Column functions on text against plain Python."""

from hashlib import md5

import pytest

from codeloom.functions import text as X
from pyspark.sql import functions as F


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_ngrams(spark):
    texts = ["a b c", "one", "", None, "// ***", "x_1 y-2 é z"]
    assert values(spark, texts, X.ngrams("t")) == [(["a b", "b c"],), (["one"],), (None,), (None,), (None,), (["x_1 y", "y 2", "2 z"],)]
    assert values(spark, ["a b c d", "a b"], X.ngrams("t", 3)) == [(["a b c", "b c d"],), (["a b"],)]
    with pytest.raises(ValueError):
        X.ngrams("t", 1)
    assert values(spark, ["a b"], X.ngram_fingerprint("t")) == [([md5(b"a b").hexdigest()[:16]],)]


def test_json_fingerprints_are_unsigned(spark):
    assert values(spark, ["[1, 18446744073709551615]", "no", None, "[]"], X.from_json_fingerprint("t")) == [(["0000000000000001", "f" * 16],), (None,), (None,), ([],)]


def test_search_folds_ascii_only(spark):
    assert values(spark, ["ABC", "100% _v", "É"], X.contains_ascii_folded("t", "b"), X.contains_ascii_folded("t", "0% _"), X.contains_ascii_folded("t", "é")) == [(True, False, False), (False, True, False), (False, False, False)]


def test_extensions(spark):
    paths = ["a/b.c", "x.tar.gz", ".bashrc", "a.b/c", "A.C", "dir/.x.h", "trail."]
    assert [r[0] for r in values(spark, paths, X.extension("t"))] == [".c", ".gz", "", "", ".C", ".h", ""]


def test_lines(spark):
    texts = ["a\nb\n\nc\n", "", None, "x\r\ny\x0bz", "one", "\n"]
    want = [(t or "").splitlines() for t in texts]
    assert [r[0] for r in values(spark, texts, X.tail_lines("t", 2))] == ["\n".join(w[-2:]) for w in want]
    got = [r[0] for r in values(spark, texts, X.tail_lines_with_ends("t", 2))]
    for r, t in zip(got, texts):
        tail = (t or "").splitlines(keepends=True)[-2:]
        assert (r.text, r.line_count, r.char_count) == ("".join(tail), len(tail), len("".join(tail)))


def test_similarity(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), ("é", "e"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(X.edit_similarity("a", "b")).collect()] == [1.0, pytest.approx(2 / 3), 0.0, None]
    assert values(spark, [" a b\x1cc\t", None], X.without_space("t"), X.first_line("t")) == [("abc", " a b\x1cc\t"), (None, "")]
    assert values(spark, ["x\r\ny", "a\rb"], X.first_line("t")) == [("x",), ("a",)]


def test_sets(spark):
    df = spark.createDataFrame([([1, 2, 2], [1, 2, 3, 4]), ([5], [1]), ([1], [])], "c array<int>, r array<int>")
    assert [tuple(x) for x in df.select(X.coverage("c", "r"), X.residual("c", "r")).collect()] == [(0.5, [3, 4]), (0.0, [1]), (0.0, [])]


def test_references(spark):
    rows = [("r", "p", "function", " int f(int a) { x }", "q"), ("", "p", "type", "struct S {};", "q"), (None, None, "global", "", "q"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "repository string, relative_path string, kind string, text string, qualified_name string").coalesce(1)
    ref = F.struct("*")
    got = [tuple(r) for r in df.select(X.reference_path(ref), X.reference_path_or_name(ref), X.reference_segment(ref, F.lit(3))).collect()]
    assert got[0] == ("r/p", "r/p", "/* Retrieved reference 3: r/p | function */\nint f(int a);\n\n")
    assert got[1] == ("p", "p", "/* Retrieved reference 3: p | type */\nstruct S {};\n\n")
    assert got[2] == ("", "q", "/* Retrieved reference 3:  | global */\n\n") and got[3][1] == "UNKNOWN"


def test_structure_fold(spark):
    h = lambda s: md5(s.encode()).hexdigest()
    df = spark.createDataFrame([(["a", "b"],)], "k array<string>")
    assert df.select(X.fold_structure("k")).first()[0] == h(h("0" + "a") + "b")
    assert values(spark, ["x"], X.leaf_digest("t")) == [(h("0" + h("x")),)]
