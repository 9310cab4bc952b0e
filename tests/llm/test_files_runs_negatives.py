"""Files of id planes, periodic runs and hard negatives against brute force, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import hard_negatives, id_planes, queries, runs  # noqa: E402

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


# op11


@pytest.mark.parametrize("unit", [8, 1])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(unit)
    for n, top in [(1, 1), (7, 2), (64, 1 << 16), (1000, 49_408), (8193, 1 << 32), (10, 1)]:
        ids = rng.integers(0, top, n, dtype=np.uint32)
        planes = id_planes.to_planes(ids, unit)
        assert len(planes) == -(-int(ids.max()).bit_length() // unit)
        assert (id_planes.from_planes(planes, n, unit) == ids).all()


def test_encoder_is_the_library(tok):
    encoder, rng = id_planes.Encoder(WORDS), random.Random(3)
    assert encoder.parts and encoder.small and encoder.dtype.itemsize == 2
    bits = ["the", "Word", "don't", "ÉTÉ", "Straße", "ΣΣ", "日本語", "naïve", "x̸", "<", "̸", "<|endoftext|>", "<|", "|>", "...", "'s", "'", "12", "½", "🙂", "\t", "\r\n", "\n", " ", "  ", " ", " ", "\x85", "ﬁ", "Ⅷ", "İ", "_", "a" * 300]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encoder.encode(text), dtype=encoder.dtype).tolist() == ids_of(tok, text), repr(text)


def test_encoder_refuses_joined_words():
    with pytest.raises(ValueError, match="joins words"):
        id_planes.Encoder(BYTES)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(id_planes, "MEMO_BYTES", 5000)
    memo, calls = id_planes._Memo(lambda k: calls.append(k) or k.encode()), []
    for k in range(400):
        assert memo[f"w{k}"] == f"w{k}".encode()
        memo.age()
        assert len(memo) + len(memo.old) < 80
    assert memo["w399"] == b"w399" and memo["z" * 1000] == b"z" * 1000 and "z" * 1000 not in memo and len(calls) == 401


ODD = [(5, "Some text, here.", "a"), (None, "no id", "b"), (2, None, "c"), (2, "", "d"), (9, "long words " * 40_000, "e"), (5, "Some text, here.", "f"), (-3, "x\x00 y <|endoftext|>", "g"), (7, "v" * 60_000, "h")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, ids string").repartition(3)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_every_document_in_order(spark, odd, tok, planes, monkeypatch, tmp_path):
    monkeypatch.setattr(id_planes, "BLOCK", 1000)  # the driver's value: headers are packed by workers, so this only proves that readers use the file's
    files = id_planes.write_ids(odd, WORDS, 2, planes, f"file://{tmp_path}")
    rows = sorted(id_planes.read_ids(files).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None, -3, 2, 2, 5, 5, 7, 9]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = sorted((i is not None, i or 0, ids_of(tok, t) + [2]) for i, t, _ in ODD)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in rows) == want
    whole = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in rows])
    for a, b in [(0, at), (3, 9), (70_000, 90_000), (at - 1, at + 5), (5, 5)]:
        some = sorted(id_planes.read_range(files, a, b).collect(), key=lambda r: r.start)
        assert b"".join(r.ids for r in some) == whole[a:b].tobytes() and (a == b or some[0].start == a)


def test_a_range_reads_its_chunks_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(id_planes, "BLOCK", 100)
    path = tmp_path / "x.planes"
    writer = id_planes.PlaneWriter(open(path, "wb"), np.dtype("<u4"), 8)
    docs = [(k, np.arange(k * 7, k * 7 + k * 37, dtype="<u4")) for k in range(12)]
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    assert writer.close() == path.stat().st_size
    file = id_planes.PlaneFile(str(path))
    asked = []
    chunk = file.chunk
    file.chunk = lambda k: asked.append(k) or chunk(k)
    whole = np.concatenate([ids for _, ids in docs])
    assert (file.read(250, 420) == whole[250:420]).all() and asked == [2, 3, 4]
    assert [(i, n, b) for i, n, b in file.texts()] == [(k, sum(len(x) for _, x in docs[:k]), ids.tobytes()) for k, ids in docs]
    raw = bytearray(path.read_bytes())
    raw[id_planes._HEAD.size + 30] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="checksum|decompress|Corrupt|corrupt"):
        id_planes.PlaneFile(str(path)).read(0, 50)
    path.write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="not all of one"):
        id_planes.PlaneFile(str(path))


def test_only_files_of_the_manifest_count(odd, tmp_path):
    """What an attempt that was lost has left is not read."""
    files = id_planes.write_ids(odd, WORDS, 2, "byte", f"file://{tmp_path}").localCheckpoint()
    before = id_planes.read_ids(files).count()
    (tmp_path / "ids-000000-0000-dead.planes").write_bytes(b"half a file")
    assert id_planes.read_ids(files).count() == before == len(ODD)


def test_empty_table_has_no_files(odd):
    files = id_planes.write_ids(odd.limit(0), WORDS, 2)
    assert files.count() == 0 and id_planes.read_ids(files).count() == 0


def test_op11(spark, sf_dir, tok):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_token_planes(spark, sf_dir).collect()}
    at, want = 0, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array(ids_of(tok, r.text) + [2], dtype="<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


# op12


def all_runs(w, least):
    """Every run, by comparing every word with every later one."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_z_function():
    rng = random.Random(0)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(20))]
        assert runs.z_function(s) == [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("least", [4, 6, 12])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(least)
    for _ in range(1200):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 9, 50])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n + 1), rng.randint(1, 13)
            w[a:] = ((w[a : a + p] * n)[: rng.randint(0, n - a)] + w[a:])[: n - a] if n > a else []
        assert runs.find_runs(w, least) == all_runs(w, least), w
        assert runs.runs_of([int(x) for x in w], least) == all_runs(w, least)


def test_every_run_of_a_whole_text_is_found_once():
    assert runs.find_runs([b"a"] * 5000) == [(0, 5000, 1)]
    s = [b"x%d" % i for i in range(900)]
    assert runs.find_runs(s + s + s[:10]) == [(0, 1810, 900)] and runs.find_runs(s + s[:899]) == []


def test_odd_texts_collapse(spark):
    unit = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 6), (4, "a b " * 6), (4, "a b " * 6), (5, "é x\x1cy " * 7 + "end"), (6, "z " * 50_000), (7, "one\x00two")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in unit], "doc_id long, text string, runs string, n_words int").repartition(4)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(docs).collect())
    ab = (12, [(0, 12, 2)], "a b")
    assert got == [(0, *ab), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *ab), (4, *ab), (5, 8, [], " ".join(["é x\x1cy"] * 7 + ["end"])), (6, 50_000, [(0, 50_000, 1)], "z"), (7, 1, [], "one\x00two")]
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in runs.collapse_runs(docs, 6).where("doc_id = 5").collect()} == {5: [(0, 7, 1)]}
    with pytest.raises(ValueError):
        runs.collapse_runs(docs, 5)


def test_op12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    some = 0
    for r in rows:
        w = queries.repeat_tail(r.doc_id, (r.text or "").encode().split())
        if len(w) > 3000:
            continue
        found = all_runs(w, 12)
        some += bool(found)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want = (len(found), s, n, q, n and 1000 * n // q, digest("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in dropped)))
        assert got[r.doc_id] == want
    assert len(got) == len(rows) and some > 10


# op13


def brute(rows, every, share=(80, 100), k=5):
    out, data = [], [(i, lab, np.array([int(np.floor(256 * float(x))) for x in v], dtype=object)) for i, lab, v in rows]
    dot = lambda a, b: int((a[: len(b)] * b[: len(a)]).sum()) if len(a) and len(b) else 0
    for n, (i, lab, v) in enumerate(data):
        if i % every:
            continue
        scored = [(-dot(v, w), j, m, lb) for m, (j, lb, w) in enumerate(data) if m != n]
        for s, j, *_ in sorted(x for x in scored if x[3] == lab)[:k]:
            window = sorted((x[0], x[1]) for x in scored if x[3] != lab and share[0] * -s <= share[1] * -x[0] <= share[1] * -s)[:k]
            out += [(i, j, r, b, -s, -t) for r, (t, b) in enumerate(window, 1)]
    return sorted(out)


def vectors(rng, n, width, labels, ties):
    x = rng.normal(size=(n, width)) / 4
    x[rng.random(n) < 0.3] = np.round(rng.normal(size=width), 1)  # many rows are alike
    return [(int(i), int(rng.integers(labels)), [float(np.float32(v)) for v in (np.round(r, 1) if ties else r)]) for i, r in enumerate(x)]


@pytest.mark.parametrize("width,labels,ties", [(8, 3, True), (7, 2, False), (64, 10, False), (1, 2, True)])
def test_windows_are_those_of_brute_force(spark, width, labels, ties, monkeypatch):
    rows = vectors(np.random.default_rng(width), 240, width, labels, ties)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 64)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    found = hard_negatives.mine(hard_negatives.integer_rows(df), 20)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == brute(rows, 20) and len(got) > 20


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(0, 1, [1.0, 2.0]), (20, 1, [1.0, 2.0]), (20, 1, [1.0, 2.0]), (3, 2, [1.0, 1.9]), (4, 2, [0.9]), (5, 2, []), (6, 3, [0.0, 0.0]), (7, 1, [-1.0, 0.5, 3.0]), (40, 9, [-2.0, -2.0])]
    bad = [(60, None, [1.0]), (8, 1, None), (9, 1, [None, 1.0]), (10, 2, [nan, 1.0]), (11, 2, [inf, 1.0]), (None, 2, [1.0, 2.0]), (12, 2, [1e30, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in fine + bad], "vec_id long, label int, embedding array<float>, score string")
    found = hard_negatives.mine(hard_negatives.integer_rows(df), 20)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == brute([(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in fine], 20) and got
    assert hard_negatives.mine(hard_negatives.integer_rows(df.limit(0)), 20).count() == 0
    assert hard_negatives.mine(hard_negatives.integer_rows(df.where("vec_id = 5")), 5).count() == 0


def block(x, label, seed=0):
    ints = np.floor(256 * x)
    centroids = hard_negatives.fit_centroids(ints[:2000])
    codes, rest = hard_negatives.quantise(ints, centroids)
    place = np.arange(len(x))
    return hard_negatives.Block(place, place, label, ints, codes, rest, centroids)


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    label = rng.integers(0, 10, len(x))
    b = block(x, label)
    anchors = b.ints[:16]
    score, off = b.bounds(anchors, 0, len(x))
    true = anchors @ b.ints.T
    assert (np.abs(true - score) <= off).all()
    finder = hard_negatives.Finder(b, 5)
    for lab in np.unique(b.label[:16]).tolist():
        mine = np.flatnonzero(b.label[:16] == lab)
        near = finder.positives(anchors[mine], b.place[mine], lab)
        finder.windows(anchors[mine], b.place[mine], lab, [s.tolist() for _, s in near], (80, 100))
    assert finder.multiplied < 0.1 * finder.seen


def test_large_numbers_are_exact():
    x = np.array([[2.0**17 + 0.5, 2.0**17 - 1], [2.0**17, 2.0**17 - 1], [-(2.0**17), 3.0]])
    b = block(x, np.array([1, 1, 2]))
    row = {p: i for i, p in enumerate(b.place.tolist())}
    want = [sum(int(p) * int(q) for p, q in zip(b.ints[row[0]], b.ints[row[k]])) for k in range(3)]
    assert b.exact(b.ints[row[0]], np.array([row[k] for k in range(3)])).tolist() == want
