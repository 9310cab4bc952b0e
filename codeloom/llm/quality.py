"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Features of a line are its shape (length, letter case, symbols, digits, repeated words, bars), in bins, with the same of the
lines before and after it. Lines take their document's label for a first fit; a second fit keeps as bad, in bad documents,
only the lines the first one found likelier bad than its cut. A document's score comes from the length-weighted forward-backward marginals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, prepare
from .crf import Chain, logistic, marginals, sigmoid, train
from .toxicity import balance, labelled_sample

SAMPLE = 1200
_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, _STOP = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>{}[]\\=_+"]] = True
_MARK[[ord(c) for c in "!?"]] = True
_STOP[[ord(c) for c in ".,;:"]] = True
_EDGES = [
    np.array([8, 20, 40, 80, 160, 320, 640, 1280]),  # bytes
    np.array([1, 3, 6, 12, 25, 50, 100]),  # words
    np.array([0.02, 0.1, 0.2, 0.3, 0.5, 0.8]),  # upper case among ASCII letters
    np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4]),  # symbols
    np.array([0.002, 0.01, 0.03, 0.08]),  # ! and ?
    np.array([0.005, 0.015, 0.03, 0.06, 0.1]),  # stops
    np.array([0.005, 0.02, 0.1, 0.3]),  # digits
    np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.7]),  # words that repeat one of the line
    np.array([0.01, 0.1, 0.3, 0.6]),  # words equal to the one before
    np.array([2, 3, 4, 5, 6, 8, 12]),  # bytes a word
]
_WIDTH = 10
SIZE = len(_EDGES) * _WIDTH * 3 + 3


@dataclass
class QualityModel:
    chain: Chain
    document: np.ndarray


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines: feature indices, chain starts, bytes, and bounds by text."""
    buf, offs = K.text_buffers(texts)
    inside = np.ones(256, dtype=bool)
    inside[[10, 13]] = False
    line = K.words(buf, offs, inside, hashed=False)
    w = K.words(buf, offs, K.NOT_SPACE)
    n = len(line.start)
    if not n:
        return np.zeros((0, len(_EDGES) * 3), np.int32), np.zeros(0, bool), np.zeros(0), line.bounds

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask[buf], dtype=np.int64)]
        return total[line.end] - total[line.start]

    size = (line.end - line.start).astype(float)
    a, b = np.searchsorted(w.start, line.start), np.searchsorted(w.start, line.end)
    n_words = (b - a).astype(float)
    at = np.searchsorted(line.start, w.start, "right") - 1
    order = np.lexsort((w.hash, at))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (at[order][1:] == at[order][:-1])
    repeated = np.bincount(at[order], weights=again, minlength=n)[:n] if len(order) else np.zeros(n)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (at[1:] == at[:-1])
    doubled = np.bincount(at, weights=same, minlength=n)[:n] if len(at) else np.zeros(n)
    letters = count(_LETTER)
    ascii_letters = np.maximum(letters - count(np.arange(256) >= 0x80), 1)
    words_or_one = np.maximum(n_words, 1)
    shape = [
        size, n_words, count(_UPPER) / ascii_letters, count(_SYMBOL) / size, count(_MARK) / size, count(_STOP) / size, count(_DIGIT) / size,
        repeated / words_or_one, doubled / words_or_one, size / words_or_one,
    ]
    own = np.stack([np.searchsorted(e, s, "right") + i * _WIDTH for i, (e, s) in enumerate(zip(_EDGES, shape))], axis=1)
    first = np.zeros(n, dtype=bool)
    first[line.bounds[:-1][np.diff(line.bounds) > 0]] = True
    last = np.r_[first[1:], True]
    span = len(_EDGES) * _WIDTH
    before = np.r_[own[:1], own[:-1]] + span
    after = np.r_[own[1:], own[-1:]] + 2 * span
    before[first] = 3 * span
    after[last] = 3 * span + 1
    return np.concatenate([own, before, after], axis=1).astype(np.int32), first, size, line.bounds


def _document_features(p_bad: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    mean, top, total = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if len(some):
        total[some] = np.add.reduceat(size, bounds[some])
        mean[some] = np.add.reduceat(p_bad * size, bounds[some]) / total[some]
        top[some] = np.maximum.reduceat(p_bad, bounds[some])
    return np.column_stack([mean, np.sqrt(mean), top, np.log1p(total) / 10])


def fit_quality(sample: list[tuple[str | None, int]], share: float | None = None) -> QualityModel:
    """sample: (text, label); label 1 is good; share: of label 1 among all that are labelled. One-sided or empty samples give a constant score."""
    texts = pa.array([t for t, _ in sample], type=pa.large_string())
    y = np.array([v for _, v in sample], dtype=np.int64)
    features, first, size, bounds = _lines(texts)
    if len(set(y.tolist())) < 2 or not len(features):
        good = float(y.mean()) if len(y) else 0.5
        return QualityModel(Chain(np.zeros(SIZE)), np.array([0.0, 0.0, 0.0, 0.0, np.log((good + 0.01) / (1 - good + 0.01))]))
    text_of = np.repeat(np.arange(len(y)), np.diff(bounds))
    bad = (y[text_of] == 0).astype(np.int64)
    weight = np.sqrt(size)
    weight *= len(weight) / weight.sum()
    chain = train(features, first, bad, SIZE, weight, rounds=120)
    for _ in range(2):
        p = marginals(chain.emissions(features), first, chain)
        cut = max(0.1, float(np.quantile(p[bad == 0], 0.98)))
        kept = ((y[text_of] == 0) & (p > cut)).astype(np.int64)
        chain = train(features, first, kept, SIZE, weight, rounds=120)
    p = marginals(chain.emissions(features), first, chain)
    return QualityModel(chain, logistic(_document_features(p, size, bounds), y.astype(float), balance(y, share)))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: QualityModel = model.value
    for batch in batches:
        features, first, size, bounds = _lines(column(batch, "text"))
        x = _document_features(marginals(m.chain.emissions(features), first, m.chain), size, bounds)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sigmoid(np.column_stack([x, np.ones(len(x))]) @ m.document))], names=["doc_id", "score"])


def train_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fitted on a bounded sample of labelled documents. Cases as in labelled_sample() and fit_quality()."""
    prepare(docs.sparkSession)
    return fit_quality(*labelled_sample(docs, labels, "quality", SAMPLE))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (1: good), one row per row of docs, each whole text.

    Lines end at CR or LF; blank ones count by their length. Null and empty texts have no lines and get the model's score
    for that; repeated rows are scored each. Only the text decides a score; other columns are ignored.
    """
    prepare(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _score(it, told), "doc_id long, score double")
