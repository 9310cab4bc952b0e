"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of words with smallest period q, at least max(least, 2 q) words long, that no neighbouring word extends keeping period q. The words of a text
become small integers. Every run repeats a window of `least` / 2 words at the distance of its period, and such windows cover it whole, so
the text is first cut down to the stretches that windows met more than once in the text cover; most texts have none. Each stretch is halved again and again; Z-functions at a midpoint
say for every period how far equality reaches to both sides, which gives all repetitions across that midpoint. What goes on beyond the block's
ends is left to the larger block whose midpoint it crosses, so each run is found once at full length; runs of one interval keep the smallest period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, column, prepare

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each place of s the length of the longest common prefix of s and of what begins there; at 0 the whole length."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    a = b = 0  # s[a:b] equals a prefix, b as far right as any
    for i in range(1, n):
        k = 0
        if i < b:
            k = z[i - a]
            if k < b - i:
                z[i] = k
                continue
            k = b - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def _across(s: list[int], lo: int, mid: int, hi: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Add the repetitions of s[lo:hi] that hold words of both sides of mid and don't go on beyond lo or hi."""
    u, v = s[lo:mid], s[mid:hi]
    back, n_u, n_v = u[::-1], len(u), len(v)
    after = np.array([*z_function(v), 0])  # after[q]: v against itself, q words on
    before = np.array([*z_function(back), 0])  # before[q]: u against itself, q words back, from its end
    # u's end against v[:q], and v's beginning against u[-q:]; -1 stands between, so no match crosses over
    to_v = np.array(z_function([*back, -1, *v[::-1]]))[n_u + 1 :][::-1]  # to_v[q - 1]: how far v[:q] and u agree backwards
    to_u = np.array(z_function([*v, -1, *u]))[n_v + 1 :][::-1]  # to_u[q - 1]: how far u[-q:] and v agree forwards

    def keep(q: np.ndarray, backwards: np.ndarray, forwards: np.ndarray, first: np.ndarray) -> None:
        """The period's first copy begins at `first`; words agree with those q on, `backwards` before it and `forwards` from it."""
        good = np.flatnonzero((backwards + forwards >= q) & (backwards + forwards + q >= least))
        for p, start, end in zip(q[good].tolist(), (first[good] - backwards[good]).tolist(), (first[good] + q[good] + forwards[good]).tolist()):
            if start == lo and lo and s[lo - 1] == s[lo - 1 + p] or end == hi and hi < len(s) and s[hi] == s[hi - p]:
                continue
            if p < found.get((start, end), len(s)):
                found[start, end] = p

    q = np.arange(1, n_v + 1)  # one copy at mid, the next in v
    reach = to_v + np.where(to_v == q, before[np.minimum(q, n_u)], 0)
    keep(q, reach, after[q], np.full(n_v, mid))
    q = np.arange(1, n_u + 1)  # one copy in u, the next at mid
    reach = to_u + np.where(to_u == q, after[np.minimum(q, n_v)], 0)
    keep(q, before[q], reach, mid - q)


def runs_of(s: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of s of at least `least` words, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(s))]
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        _across(s, lo, mid, hi, least, found)
        blocks += [(lo, mid), (mid, hi)]
    return sorted((start, end - start, p) for (start, end), p in found.items())


def _stretches(s: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Where windows of k words that are met more than once in s cover it. Windows are told apart by exact names, made by pairing shorter ones."""
    n = len(s) - k + 1
    if n < 2:
        return []
    name, size = s, 1
    while size < k:
        step = min(size, k - size)
        pair = name[: len(s) - size - step + 1] * np.int64(len(s) + 1) + name[step : step + len(s) - size - step + 1]
        size += step
        if size < k:
            name = np.unique(pair, return_inverse=True)[1]
        else:
            name = pair
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    if not same.any():
        return []
    edge = np.zeros(len(s) + 1, dtype=np.int64)
    met = np.unique(np.r_[order[1:][same], order[:-1][same]])
    np.add.at(edge, met, 1)
    np.add.at(edge, met + k, -1)
    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def find_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period."""
    if len(words) < least:
        return []
    names: dict[bytes, int] = {}
    s = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for a, b in _stretches(s, least // 2):
        out += [(a + start, length, p) for start, length, p in runs_of(s[a:b].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _runs(batches: Iterator[pa.RecordBatch], least: int, edit) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids, n, runs, texts = zip(*rows)
        bounds = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        flat = np.array([x for r in runs for x in r], dtype=np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(RUN))
        return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(n, type=pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), structs), pa.array(texts, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist()):
            words = (text or b"").split()  # of bytes: at 0x20 and 0x09-0x0D, no other white space
            if edit is not None:
                words = edit(doc_id, words)
            runs = find_runs(words, least)
            collapsed = b" ".join(kept_words(words, runs))
            rows.append((doc_id, len(words), runs, collapsed))
            size += len(collapsed) + 24 * len(runs) + 16
            if size >= BATCH_BYTES:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


def collapse_runs(docs: DataFrame, least: int = 12, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the kept words joined by single spaces.

    Words are what stands between the bytes 0x20 and 0x09-0x0D. A run has at least `least` words (4 or more, even) and two periods; of its words all after the first
    period are dropped. edit: changes the words of a document before they are looked at. One row per row of docs, each
    by its own text, repeated rows and rows without an id included. Null and empty texts have no words, no runs and collapse to ''. Other columns are ignored.
    A text's work grows with n log n in its stretches of repeated windows, whatever it holds.
    """
    if least < 4 or least % 2:
        raise ValueError("least must be even, and 4 or more")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _runs(it, least, edit), SCHEMA)
