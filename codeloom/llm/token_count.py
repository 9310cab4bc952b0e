"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is split at spaces and line feeds, where the tokenizers served here always begin a new token, so the count of a text is the sum over its
pieces; a tokenizer for which probes show another count is refused when it is loaded. Pieces repeat, so each worker keeps the counts
of those it has seen lately in two generations of bounded bytes, and encodes the rest in batches of equal bytes. A long piece, in which nothing
but the tokenizer knows safe boundaries, makes a batch of its own and isn't kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

#: Bytes of pieces that a generation of the memo holds, each with MEMO_ROW bytes for its place; bytes of pieces in one call of the encoder; of the longest piece that is kept.
MEMO_BYTES, MEMO_ROW, CALL_BYTES, KEPT_BYTES = 64 << 20, 150, 1 << 18, 1 << 10
#: Texts whose counts tell whether a tokenizer begins a new token at every space and line feed.
PROBES = ["a b", "the  quick brown\nfox", " lead and trail ", "line\n\nline", "New York is in the state", "1 000 000", "x = y + z;\n\treturn", "in order to be or not to be", "été à la plage", "日本 語 の"]


class Memo:
    """Two generations of a piece -> value map; the older one is dropped when the younger holds `size` bytes. cost: bytes of a value."""

    def __init__(self, encode, size: int = MEMO_BYTES, cost=lambda value: 0):
        self.encode, self.size, self.cost = encode, size, cost
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def __call__(self, pieces: set) -> dict:
        """Values of all pieces, as a map that holds at least them."""
        young, old = self.young, self.old
        missing, long = [], []
        for p in pieces - young.keys():
            if len(p) > KEPT_BYTES:
                long.append(p)
            elif p in old:
                young[p] = value = old[p]
                self.held += MEMO_ROW + len(p) + self.cost(value)
            else:
                missing.append(p)
        for p, value in zip(missing, self.encode(missing)):
            young[p] = value
            self.held += MEMO_ROW + len(p) + self.cost(value)
        told = young if not long else {**{p: young[p] for p in pieces if p in young}, **dict(zip(long, self.encode(long)))}
        if self.held > self.size:
            self.old, self.young, self.held = young, {}, 0
        return told


def by_bytes(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Pieces in calls of at most `most` bytes of UTF-8, or of one piece."""
    held, total = [], 0
    for p in pieces:
        size = len(p) if p.isascii() else len(p.encode())
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(p)
        total += size
    if held:
        yield held


def _json_lengths(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def lengths(pieces: list[str]) -> list[int]:
        out: list[int] = []
        for call in by_bytes(pieces):
            out += [len(e) for e in tok.encode_batch_fast(call, add_special_tokens=False)]
        return out

    for text in PROBES:
        if sum(lengths(_pieces(text))) != lengths([text])[0]:
            raise ValueError(f"{path} joins words across white space, so its counts aren't sums over pieces")
    return lengths


def _pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


_memos: dict[str, Memo] = {}


def _counts(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _memos:
        _memos[path] = Memo(_json_lengths(path))
    memo = _memos[path]
    for batch in batches:
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        split = [_pieces(t) for t in texts]
        value = memo(set().union(*split)) if split else {}
        n = [sum(map(value.__getitem__, pieces)) for pieces in split]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([len(t.encode()) for t in texts], type=pa.int64()), pa.array(n, type=pa.int64()), pa.array([x > limit for x in n], type=pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, one row per row of docs.

    path: a tokenizer .json that ends words at white space (others raise); it must be there on every executor. No special tokens are added; strings of
    special tokens inside a text count as the library counts them. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows
    are counted each. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _counts(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
