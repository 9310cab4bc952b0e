"""Toxicity: a linear-chain conditional random field over word tokens, with document scores from its marginals.

Labels are given by document, so token labels for training are derived first: a feature (a whole word or a prefix) is toxic if
the words it stands beside, counted once each on either side so that copies of a document count about once, lie mostly in toxic
documents, more surely than chance could have it; a token of a toxic document with a toxic feature is labelled 1, all others 0. The field is trained on the
token chains of a bounded sample of labelled documents and then tags every token of every document. A document's score is a
logistic function of its expected number of toxic tokens, its largest marginal and their share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import but, column, digested, prepare, saved
from .crf import Chain, logistic, marginals, sigmoid, train

#: Labelled documents that the field may be fitted on, of each label, and the longest of them in characters.
SAMPLE, SAMPLE_CHARS = 600, 50_000
PREFIXES = (4, 5, 6, 7)
#: A toxic feature's least log-odds, and least log-likelihood ratio against chance (11: about one in a million).
MIN_ODDS, MIN_SURPRISE = 2.0, 11.0
BITS = 20
SIZE = 1 << BITS


@dataclass
class ToxicityModel:
    chain: Chain
    document: np.ndarray


def _latin_lower(buf: np.ndarray) -> np.ndarray:
    """The bytes with U+00C0 to U+00DE in lower case; lengths stay as they are. (ASCII is folded when words are hashed.)"""
    capital = np.zeros(len(buf), dtype=bool)
    capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    if not capital.any():
        return buf
    return np.where(capital, buf + np.uint8(0x20), buf).astype(np.uint8)


def _tokens(texts: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their feature indices, chain starts, and byte offsets of texts."""
    buf, offs = K.text_buffers(texts)
    buf = _latin_lower(buf)
    w = K.words(buf, offs, K.ALNUM)
    cols = [w.hash]
    for n in PREFIXES:
        end = np.minimum(w.start + n, w.end)
        h = K._word_hashes(buf, w.start, end, K.LOWER)
        cols.append(K.mix(h + np.uint64(n)))
    features = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cols], axis=1) if len(w.start) else np.zeros((0, len(cols)), np.int32)
    first = np.zeros(len(w.start), dtype=bool)
    first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    return w, features, first, offs


def _document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By document: log of the expected toxic tokens among the likely ones, the largest marginal, their share."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    total, top = np.zeros(len(n)), np.zeros(len(n))
    if len(some):
        total[some] = np.add.reduceat(np.where(p > 0.2, p, 0), bounds[some])
        top[some] = np.maximum.reduceat(p, bounds[some])
    return np.column_stack([np.log1p(total), top, np.sqrt(total / np.maximum(n, 1))])


def _toxic_features(features: np.ndarray, w: K.Words, toxic: np.ndarray) -> np.ndarray:
    """By feature: whether its distinct neighbours lie mostly, and surely, in toxic documents."""
    h = w.hash
    around = np.r_[np.uint64(0), h[:-1]], np.r_[h[1:], np.uint64(0)]
    flag = toxic[w.text_of]
    counts = []
    for side in (True, False):
        mine = np.flatnonzero(flag == side)
        got = np.zeros(SIZE)
        for j in range(features.shape[1]):
            f = features[mine, j]
            seen = []
            for near in around:  # each neighbouring word counts once
                _, once = np.unique(K.mix(near[mine]) + f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                seen.append(np.bincount(f[once], minlength=SIZE))
            got += np.minimum(*seen)
        counts.append(got)
    a, b = counts
    na, nb = max(1.0, a.sum()), max(1.0, b.sum())
    odds = np.log((a + 0.5) / na) - np.log((b + 0.5) / nb)
    share = na / (na + nb)
    both = np.maximum(a + b, 1)
    surprise = a * np.log(np.maximum(a, 1e-9) / (both * share)) + b * np.log(np.maximum(b, 1e-9) / (both * (1 - share)))
    return (a >= 4) & (odds > MIN_ODDS) & (surprise > MIN_SURPRISE)


def fit_toxicity(sample: list[tuple[str | None, int]], share: float | None = None) -> ToxicityModel:
    """sample: (text, label) of labelled documents; label 1 is toxic; share: of label 1 among all that are labelled
    (default: as in the sample). One-sided or empty samples give a model that scores every text low (or high)."""
    texts = pa.array([t for t, _ in sample], type=pa.large_string())
    y = np.array([v for _, v in sample], dtype=np.int64)
    w, features, first, _ = _tokens(texts)
    if len(set(y.tolist())) < 2 or not len(features):
        rate = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(Chain(np.zeros(SIZE), bias=-30.0), np.array([0.0, 0.0, 0.0, np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5 + 4))]))
    marked = _toxic_features(features, w, y == 1)
    label = (marked[features].any(axis=1) & (y[w.text_of] == 1)).astype(np.int64)
    chain = train(features, first, label, SIZE, rounds=40, rate=0.5, ridge=1e-6)
    p = marginals(chain.emissions(features), first, chain)
    return ToxicityModel(chain, logistic(_document_features(p, w.bounds), y.astype(float), balance(y, share)))


def _score(batches: Iterator[pa.RecordBatch], model, spans: bool) -> Iterator[pa.RecordBatch]:
    m: ToxicityModel = model.value
    for batch in batches:
        w, features, first, offs = _tokens(column(batch, "text"))
        p = marginals(m.chain.emissions(features), first, m.chain)
        x = _document_features(p, w.bounds)
        cols, names = but(batch, "text")
        cols.append(pa.array(sigmoid(np.column_stack([x, np.ones(len(x))]) @ m.document)))
        names.append("score")
        if spans:
            hit = np.flatnonzero(p >= 0.5)
            who = w.text_of[hit]
            rows = pa.StructArray.from_arrays(
                [pa.array((w.start[hit] - offs[who]).astype(np.int32)), pa.array((w.end[hit] - offs[who]).astype(np.int32)), pa.array(p[hit])], names=["start", "end", "p"]
            )
            cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)), rows))
            names.append("spans")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def balance(y: np.ndarray, share: float | None) -> np.ndarray:
    """Row weights that make label 1 as frequent as share says."""
    if share is None:
        return np.ones(len(y))
    return np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str | None, int]], float | None]:
    """A sample, and the share of label 1 among all labels: up to `most` documents of each label, in the order of a hash of their id.

    Documents over `chars` and those without a text aren't drawn, and others take their places. Labels other than 0 and 1 and null ids don't count. An id with
    both labels has 0, one with several texts the least of them. Without labels the share is None and the sample empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"))
    share = labels.agg(F.avg("label")).first()[0]
    known = saved(docs.select("doc_id").join(labels, "doc_id").distinct())
    chosen = [(r.doc_id, side) for side in (0, 1) for r in known.where(F.col("label") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not chosen:
        return [], share
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.label, r.doc_id))], share


def train_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fitted on a bounded sample of labelled documents. Cases as in labelled_sample() and fit_toxicity()."""
    prepare(docs.sparkSession)
    return fit_toxicity(*labelled_sample(docs, labels, "toxic"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, spans: bool = False, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id [, digest], score [, spans], one row per row of docs, each whole text.

    spans: offending tokens as (start, end) byte offsets with their marginal; digest: of the text, to tell rows of one id apart. Null and empty
    texts have no tokens and get the score of a text without toxic tokens; repeated rows are scored each. Only the text decides a score; other columns are ignored.
    """
    prepare(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    docs = digested(docs) if digest else digested(docs).drop("digest")
    schema = "doc_id long" + ", digest long" * digest + ", score double" + ", spans array<struct<start: int, end: int, p: double>>" * spans
    return docs.mapInArrow(lambda it: _score(it, told, spans), schema)
