"""Vectorised text kernels over Arrow string buffers: word boundaries, word hashes and hashes of word windows.

Hashes are 64-bit: inside a word each byte has a random value and each place a random multiplier of its own (not powers of one base,
whose sums vanish for some pairs of words whatever the base), across the words of a window there are odd multipliers; both end in a
mixing step. All constants come from one seeded generator, so every worker has the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = 1 << 20
#: Places of a word whose multipliers are kept in a table.
_PLACES = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of alphanumeric words: digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return _place_multipliers(np.arange(_PLACES, dtype=np.uint64))


def _place_multipliers(at: np.ndarray) -> np.ndarray:
    """The odd multiplier of each place in a word."""
    return mix(mix(at + _STEP[-3]) ^ _STEP[-4]) | np.uint64(1)


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (n + 1 offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of a batch of texts: byte ranges, hashes, and the range of words of each text (n + 1 bounds)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER, hashed: bool = True) -> Words:
    """inside: which bytes belong to words; fold: the byte each byte counts as; hashed: whether hashes are wanted, too."""
    n = len(buf)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offs), dtype=np.int64))
    m = inside[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    at = offs[:-1]
    at = at[(at < n) & (np.diff(offs) > 0)]
    first[at] = m[at]
    before = at[at > 0] - 1
    last[before] = m[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, _word_hashes(buf, start, end, fold) if hashed else np.zeros(0, dtype=np.uint64), np.searchsorted(start, offs))


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), which are in order and don't overlap. Memory follows _SLICE, not the longest word."""
    values = _BYTE[fold]
    table = _multipliers()
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + _SLICE, "right"))
        if j <= i:  # a word longer than a slice
            total = 0
            for b in range(a, int(end[i]), _SLICE):
                some = buf[b : min(b + _SLICE, int(end[i]))]
                at = np.arange(b - a, b - a + len(some), dtype=np.uint64)
                total += int(np.sum(values[some] * _place_multipliers(at), dtype=np.uint64))
            out[i] = total % 2**64
            i += 1
            continue
        b = int(end[j - 1])
        s = start[i:j] - a
        place = np.arange(b - a) - np.repeat(s, np.diff(np.r_[s, b - a]))
        far = place >= _PLACES
        by = table[np.minimum(place, _PLACES - 1)]
        if far.any():
            by[far] = _place_multipliers(place[far].astype(np.uint64))
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(values[buf[a:b]] * by, out=total[1:])
        out[i:j] = total[end[i:j] - a] - total[s]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * _STEP[-1]))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, by the position of the first; bounds of texts are the caller's matter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, k * int(_STEP[-2]) % 2**64, dtype=np.uint64)
    for j in range(k):
        total += h[j : j + n] * _STEP[j % 4000]
    return mix(total)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of each window of k words that lies within one text."""
    h = window_hashes(w.hash, k)
    left = np.repeat(w.bounds[1:], np.diff(w.bounds))[: len(h)] - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    return at, h[at]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each k-word shingle; a text of fewer words has its whole sequence as the only one."""
    at, h = windows(w, k)
    text_of = w.text_of
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return text_of[at], h
    extra = np.array([window_hashes(w.hash[w.bounds[i] : w.bounds[i + 1]], int(counts[i]))[0] for i in short], dtype=np.uint64)
    who = np.concatenate([text_of[at], short])
    order = np.argsort(who, kind="stable")
    return who[order], np.concatenate([h, extra])[order]


def distinct_by_text(who: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text in a row, and n + 1 bounds."""
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    who, h = who[keep], h[keep]
    return h, np.searchsorted(who, np.arange(n + 1))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
