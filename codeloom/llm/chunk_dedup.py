"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends at white space where the gear hash of the 32 bytes before it is the least among `NEAR` words in a row, so an insertion moves only
the boundaries near it, equal passages give equal chunks wherever they stand, and any NEAR words hold a boundary: a passage of 51 words has at least six in whole chunks
that all its holders cut alike, if its first 32 bytes are no more than eight words. Runs without such a place are cut every
`MAX_BYTES` after the last boundary, repetitions of one word at every word. Chunks are counted by digest (combined before the shuffle);
chunks that several documents hold are found again by their digest, those of the most frequent digests where they are cut, and consecutive ones join to runs.

Runs only say where to look. What is reported are windows of `MIN_WORDS` words that several documents hold, by 128 bits: about a run
shorter than a window every one as far as a passage can reach, which is into the next chunk; in a longer run those that begin with a chunk, and at its two
ends again every one as far as a passage can reach. Where another document has a run's first or last chunk inside a longer run, it compares the windows of such an end there, too. A
document's passages are the unions of its shared windows, so their ends are true wherever a passage ends for all who hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import HOT_ROWS, HOT_SHARE, column, join_hot, prepare, saved

NEAR, MAX_BYTES, MIN_WORDS, SEED_WORDS = 10, 1024, 51, 6
_rng = np.random.Generator(np.random.PCG64(11))
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
#: A second hash of words, for the other half of a window's 128 bits.
_OTHER = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.arange(256, dtype=np.uint8)
#: Bytes that a boundary depends on; words from a passage's end to the first boundary that all its holders have (2 * NEAR - 1 at most, hardly ever more than this); words by which
#: chunks of a word or two, shared by chance, may lead a long run on behind a passage's end.
GEAR_BYTES, REACH, ADDED = 32, 14, 8
#: Words between anchors inside a chunk of many words.
ANCHOR_WORDS = 25
_CHUNK = "doc_id long, d long, chunk int, start int, end int, words int, first_doc long"


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2 h + G[byte], which depends on the last 32 bytes; by doubling, not byte by byte."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    return h


_NONE = np.uint64(2**64 - 1)


def _least(value: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Which words have the least value (the last of equal ones) of some NEAR words in a row of their text; _NONE is no value."""
    out = np.zeros(len(value), dtype=bool)
    n = len(value) - NEAR + 1
    if n < 1:
        return out
    best, at = value[:n].copy(), np.arange(n)
    for j in range(1, NEAR):
        better = value[j : j + n] <= best
        best[better] = value[j : j + n][better]
        at[better] = np.flatnonzero(better) + j
    out[at[(text_of[:n] == text_of[NEAR - 1 :]) & (best != _NONE)]] = True
    return out


def chunk_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the chunks of all texts; chunks end before white space and begin at words."""
    n_texts = len(offs) - 1
    w = K.words(buf, offs, K.NOT_SPACE)
    if not len(w.start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    h = gear(buf)
    text_of = w.text_of
    last = np.zeros(len(w.start), dtype=bool)
    last[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
    # the hashed bytes must lie within the text: its first 32 have no boundary
    inside = w.end - offs[text_of] >= GEAR_BYTES
    cut = last | _least(np.where(inside, K.mix(h[w.end - 1].astype(np.uint64)) >> np.uint64(1), _NONE), text_of)
    # a word said over and over gives the hash nothing new: NEAR and more of one kind in a row are chunks of a word each
    same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (text_of[1:] == text_of[:-1])]
    run = np.cumsum(~same) - 1
    ends = np.flatnonzero(cut | (np.bincount(run)[run] >= NEAR))
    begins = np.r_[0, ends[:-1] + 1]
    start, end, who = w.start[begins], w.end[ends], text_of[begins]
    if (end - start > MAX_BYTES).any():
        out = []
        for s, e, b, k in zip(start.tolist(), end.tolist(), begins.tolist(), ends.tolist()):
            while e - s > MAX_BYTES and b < k:
                j = max(b, int(np.searchsorted(w.end, s + MAX_BYTES, "right")) - 1)
                if j >= k:
                    break
                out.append((s, int(w.end[j]), int(text_of[b])))
                b = j + 1
                s = int(w.start[b])
            out.append((s, e, int(text_of[b])))
        start, end, who = (np.array(x, dtype=np.int64) for x in zip(*out))
    assert n_texts
    return start, end, who


def _chunks(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> the chunks of each; hot: sorted digests, and the least document of each, that first_doc tells at once."""
    digests, homes = hot.value
    for batch in batches:
        buf, offs = K.text_buffers(column(batch, "text"))
        start, end, who = chunk_bounds(buf, offs)
        if not len(start):
            continue
        d = K._word_hashes(buf, start, end, _SAME).view(np.int64)
        w = K.words(buf, offs, K.NOT_SPACE, hashed=False)
        n_words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
        first = np.searchsorted(who, who)
        ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
        home = pa.nulls(len(d), pa.int64())
        if len(digests):
            at = np.minimum(np.searchsorted(digests, d), len(digests) - 1)
            home = pa.array(homes[at], mask=digests[at] != d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[who].astype(np.int64)), pa.array(d)] + [pa.array(x.astype(np.int32)) for x in (np.arange(len(who)) - first, start - offs[who], end - offs[who], n_words)] + [home],
            names=["doc_id", "d", "chunk", "start", "end", "words", "first_doc"],
        )


_RUN = "struct<start: int, end: int, words: int>"
_PLACE = "struct<d: long, start: int>"
_OUTER = "struct<d: long, first: boolean>"


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream sorted by doc_id, cut between documents: tables of a batch's size, or of one document's rows where it has more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = column(batch, "doc_id").to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        if held and (cut or column(held[-1], "doc_id")[-1].as_py() != doc[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _runs(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, d, chunk, start, end, words) sorted by doc_id, chunk -> each document's runs of chunks.

    `outer` has the digests of the first and the last chunk of each run, `inner` digests and places of the chunks in runs of `size` words and more.
    """
    for t in whole_documents(batches):
        names = ("doc_id", "chunk", "start", "end", "words", "d")
        doc, chunk, start, end, words, d = (t.column(c).to_numpy() for c in names)
        other = np.r_[True, np.diff(doc) != 0]
        keep = other | np.r_[True, np.diff(chunk) != 0]  # repeated rows of one document give the same chunk twice
        doc, chunk, start, end, words, d, other = (x[keep] for x in (doc, chunk, start, end, words, d, other))
        at = np.flatnonzero(other | np.r_[True, np.diff(chunk) > 1])
        total = np.add.reduceat(words, at)
        till = np.r_[at[1:], len(chunk)] - 1
        inner = np.repeat(total >= max(least, size), till - at + 1)
        at, till, total = (x[total >= least] for x in (at, till, total))
        if not len(at):
            continue
        home = np.flatnonzero(np.r_[True, np.diff(doc[at]) != 0])
        docs, bounds = doc[at][home], np.r_[home, len(at)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs),
                _lists(bounds, start=start[at], end=end[till], words=total.astype(np.int32)),
                _lists(2 * bounds, d=np.column_stack((d[at], d[till])).ravel(), first=np.tile([True, False], len(at))),
                _lists(np.r_[np.searchsorted(doc[inner], docs), inner.sum()], d=d[inner], start=start[inner]),
            ],
            names=["doc_id", "runs", "outer", "inner"],
        )


def _lists(bounds: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """Lists of structs, list i from row bounds[i] to bounds[i + 1]."""
    rows = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)


def wanted_windows(runs: list[dict], places: list[dict], start: np.ndarray, end: np.ndarray, chunk_start: np.ndarray, chunk_end: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows to compare in a text whose words and chunks lie at those bytes (module docstring); sorted, once each."""
    n = len(start)
    want = np.zeros(n + 1, dtype=np.int32)

    def take(a: int, b: int) -> None:
        a, b = max(0, a), min(b, n - size)
        if a <= b:
            want[a] += 1
            want[b + 1] -= 1

    first_word, end_word = np.searchsorted(start, chunk_start), np.searchsorted(end, chunk_end) + 1
    # a passage begins at most REACH words and GEAR_BYTES before its first common chunk, and ends at most REACH words behind its last one
    begin = lambda c: int(np.searchsorted(start, start[max(0, min(int(first_word[c]) - REACH, int(first_word[c - 1]) if c else 0))] - GEAR_BYTES))
    finish = lambda c: min(n, max(int(end_word[c]) + REACH, int(end_word[min(c + 1, len(end_word) - 1)])))
    lone = []
    for r in runs:
        a, b = int(np.searchsorted(chunk_start, r["start"])), int(np.searchsorted(chunk_end, r["end"]))
        if r["words"] < size:
            take(begin(a), finish(b) - size)
            continue
        f = first_word[a : b + 1]
        times = (end_word[a : b + 1] - f + ANCHOR_WORDS - 1) // ANCHOR_WORDS
        lone.append(np.repeat(f, times) + ANCHOR_WORDS * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)))
        take(begin(a), int(first_word[a]) + ADDED)
        take(int(end_word[b]) - size - ADDED, finish(b) - size)
    for p in places:
        c = int(np.searchsorted(chunk_start, p["start"]))
        if p["begins"]:
            take(begin(c), int(first_word[c]) + ADDED)
        if p["ends"]:
            take(int(end_word[c]) - size - ADDED, finish(c) - size)
    flag = np.cumsum(want)[:n] > 0
    if lone:
        at = np.concatenate(lone)
        flag[at[at <= n - size]] = True
    return np.flatnonzero(flag)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, runs, places) -> (doc_id, h, g, at, start, end) of the windows to compare: 128 bits, first word, bytes."""
    for batch in batches:
        buf, offs = K.text_buffers(column(batch, "text"))
        w = K.words(buf, offs, K.NOT_SPACE, _SAME)
        h, g = K.window_hashes(w.hash, size), K.window_hashes(K.mix(w.hash ^ _OTHER), size)
        c_start, c_end, c_text = chunk_bounds(buf, offs)
        out: list[list] = [[], [], [], [], [], []]
        for row, (doc, runs, places) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("doc_id", "runs", "places")))):
            low, high = int(w.bounds[row]), int(w.bounds[row + 1])
            if high - low < size:
                continue
            a, b = np.searchsorted(c_text, (row, row + 1))
            base = offs[row]
            k = wanted_windows(runs, places, w.start[low:high] - base, w.end[low:high] - base, c_start[a:b] - base, c_end[a:b] - base, size)
            for o, v in zip(out, (np.full(len(k), doc), h[k + low], g[k + low], k, w.start[k + low] - base, w.end[k + low + size - 1] - base)):
                o.append(v)
        if out[0]:
            doc, h_, g_, *rest = (np.concatenate(o) for o in out)
            cols = [doc.astype(np.int64), h_.view(np.int64), g_.view(np.int64), *(x.astype(np.int32) for x in rest)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "h", "g", "at", "start", "end"])


_PASSAGE = "struct<start: int, end: int, words: int, first_doc: long>"


def _united(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, at, start, end, first_doc) sorted by doc_id, at -> each document's passages: unions of windows that overlap."""
    for t in whole_documents(batches):
        doc, at, start, end, home = (t.column(c).to_numpy() for c in ("doc_id", "at", "start", "end", "first_doc"))
        first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(at) >= size)])
        last = np.r_[first[1:], len(at)] - 1
        begins = np.flatnonzero(np.r_[True, np.diff(doc[first]) != 0])
        words = (at[last] - at[first] + size).astype(np.int32)
        passages = _lists(np.r_[begins, len(first)], start=start[first], end=end[last], words=words, first_doc=np.minimum.reduceat(home, first))
        yield pa.RecordBatch.from_arrays([pa.array(doc[first][begins]), passages], names=["doc_id", "passages"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_repeated_words, n_later_words, passages, repeated: one row per row of docs.

    passages: byte ranges of words that lie in windows of min_words words which other documents hold too, with the least id that holds (one of) them;
    n_later_words counts those of which an earlier document, by id, holds a copy. A passage that repeats only inside one
    document is none. Null and empty texts, and texts of white space, have none; repeated rows of one id count as one
    document (of several texts under one id the one with the least digest). Rows whose doc_id is null have none. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = docs.select("doc_id")
    docs = _one_text(docs.where("doc_id is not null"))
    hot = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    counted = docs.mapInArrow(lambda it, hot=hot: _chunks(it, hot), _CHUNK).groupBy("d")
    several = saved(counted.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"))
    # digests so frequent that one task would get too many of their chunks: fewer than HOT_SHARE, whatever the data
    least = max(HOT_ROWS, (several.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    often = several.where(F.col("n") > least).orderBy("d").select("d", "low").toArrow()
    hot = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("d", "low")))
    chunks = docs.mapInArrow(lambda it: _chunks(it, hot), _CHUNK)
    spread = F.when(F.col("first_doc").isNull(), F.col("d")).otherwise(F.xxhash64("doc_id", "chunk"))
    met = chunks.withColumn("key", spread).join(several.where(F.col("n") <= least).select(F.col("d").alias("key"), "low"), "key", "left").where("first_doc is not null or low is not null")
    dealt = met.select("doc_id", "d", "chunk", "start", "end", "words").repartition("doc_id").sortWithinPartitions("doc_id", "chunk")
    runs = saved(dealt.mapInArrow(lambda it: _runs(it, min(SEED_WORDS, min_words), min_words), f"doc_id long, runs array<{_RUN}>, outer array<{_OUTER}>, inner array<{_PLACE}>"))

    # a passage may end here and go on there: there the windows of that end are compared, too
    asked = runs.select(F.explode("outer").alias("o")).groupBy(F.col("o.d").alias("d")).agg(F.bool_or("o.first").alias("begins"), F.bool_or(~F.col("o.first")).alias("ends"))
    inside = saved(runs.select("doc_id", F.explode("inner").alias("p")).select("doc_id", "p.*"))
    asked = saved(inside.groupBy("d").agg(F.count("*").alias("n")).join(asked, "d"))
    places = join_hot(inside, asked, ["d"], "n").groupBy("doc_id").agg(F.collect_list(F.struct("start", "begins", "ends")).alias("places"))
    none = F.expr("cast(array() as array<struct<start: int, begins: boolean, ends: boolean>>)")
    look = runs.select("doc_id", "runs").join(places, "doc_id", "left").select("doc_id", "runs", F.coalesce("places", none).alias("places"))
    windows = saved(docs.join(look, "doc_id").mapInArrow(lambda it: _windows(it, min_words), "doc_id long, h long, g long, at int, start int, end int"))
    shared = windows.groupBy("h", "g").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("first_doc < high").drop("high")
    sure = join_hot(windows, saved(shared), ["h", "g"], "n").select("doc_id", "at", "start", "end", "first_doc")
    found = sure.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(lambda it: _united(it, min_words), f"doc_id long, passages array<{_PASSAGE}>")
    none = F.expr(f"cast(array() as array<{_PASSAGE}>)")
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return (
        every.join(found, "doc_id", "left")
        .withColumn("passages", F.coalesce("passages", none))
        .select(
            "doc_id", total(F.col("passages")).alias("n_repeated_words"), total(F.filter("passages", lambda p: p["first_doc"] < F.col("doc_id"))).alias("n_later_words"),
            "passages", (F.size("passages") > 0).alias("repeated"),
        )
    )


def _one_text(docs: DataFrame) -> DataFrame:
    """docs with one row an id: of repeated ids the row whose text has the least digest."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("digest")).where("n > 1")
    ids = saved(ids)
    if ids.isEmpty():
        return docs
    again = ids.select("doc_id", "digest")
    some = docs.join(again, "doc_id").where(F.xxhash64("text") == F.col("digest")).drop("digest").dropDuplicates(["doc_id"])
    return saved(docs.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(some))
