"""SentencePiece encoding and decoding with forward states shared along common prefixes.

A text becomes marked words (white space as U+2581, at the front of its word). The distinct words of a batch that the worker has not
met lately are sorted; in that order each word follows its prefixes, so walking them is a depth-first traversal of their trie, and the
forward scores of the common prefix with the word before are kept as they are.

A position's forward score holds the best last piece of the prefix that ends there. For unigram models that is the classical
Viterbi step on log probabilities. The scores of a BPE model are merge ranks, and their largest sum isn't what the library
returns; there the step admits a last piece only if merging leaves the pair (piece before, piece) as it is. Whether any cut is crossed is decided by
the two pieces beside it, so exactly one last piece survives at each position and the result is the library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare
from .token_count import Memo

MARK = "▁"
_SHIFT = 1 << 21
#: Characters of a word beyond which its trie nodes aren't kept for the word after it.
LONG = 4096
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class PieceCodec:
    """Encoder and decoder for a SentencePiece model with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave text as it is, with marks before words, are served")
        self._setup([(p.piece, p.score, p.type) for p in proto.pieces], spec.model_type, norm.add_dummy_prefix, spec.byte_fallback)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, dummy: bool = True, fallback: bool = True) -> PieceCodec:
        codec = cls.__new__(cls)
        codec._setup(pieces, kind, dummy, fallback)
        return codec

    def _setup(self, pieces, kind: int, dummy: bool, fallback: bool) -> None:
        self.kind, self.dummy = kind, dummy
        self.id, self.score, self.bytes, self.unknown = {}, {}, {}, 0
        self.table: list[bytes] = []
        for i, (piece, score, type_) in enumerate(pieces):
            shown = b""
            if type_ in (_NORMAL, _USER):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece holds a mark after other characters")
                self.id[piece], self.score[piece] = i, score
                shown = piece.replace(MARK, " ").encode()
            elif type_ == _BYTE:
                shown = bytes([int(piece[3:5], 16)])
                self.bytes[shown] = i
            elif type_ == _UNKNOWN:
                self.unknown, shown = i, " ⁇ ".encode()
            self.table.append(shown)
        self.fallback = fallback and len(self.bytes) == 256
        self.longest = max(map(len, self.id), default=1)
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.pieces = [p for p, _, _ in pieces]
        self._pairs: dict[int, bool] = {}
        self._trie: dict = {}
        for piece, i in self.id.items():
            node = self._trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[0] = i

    # forward scores

    def _merged(self, s: str) -> list[str]:
        """s after all merges, by the highest score and then the leftmost pair."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _text(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-2 - i)

    def _stands(self, before: int, piece: int) -> bool:
        """Whether merging leaves (before, piece) as it is; before is -1 at the front of a word."""
        if len(self._pairs) > 500_000:
            self._pairs.clear()
        whole = [self._text(piece)] if before == -1 else [self._text(before), self._text(piece)]
        known = self._pairs[before * _SHIFT + piece] = self._merged("".join(whole)) == whole
        return known

    def _encode_bpe(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """By position of the current path: the last piece (a character outside the vocabulary as -2 - code), where it begins,
        and the vocabulary's trie nodes that are reached from earlier positions."""
        root, pairs = self._trie, self._pairs
        last, origin, reached = [-1], [0], [[]]
        out: dict[str, tuple[int, ...]] = {}
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], origin[shared + 1 :], reached[shared + 1 :]
            for n in range(shared, len(word)):
                ch = word[n]
                nodes = [(s, x) for s, node in reached[n] if (x := node.get(ch)) is not None]
                x = root.get(ch)
                if x is not None:
                    nodes.append((n, x))
                reached.append(nodes)
                if n > LONG:
                    reached[n - LONG] = []  # no word shares a front with this one
                for s, x in nodes:
                    i = x.get(0)
                    if i is not None:
                        known = pairs.get(last[s] * _SHIFT + i)
                        if known or known is None and self._stands(last[s], i):
                            last.append(i)
                            origin.append(s)
                            break
                else:
                    last.append(-2 - ord(ch))
                    origin.append(n)
            ids: list[int] = []
            n = len(word)
            while n:
                i = last[n]
                if i >= 0:
                    ids.append(i)
                elif self.fallback:
                    ids.extend(self.bytes[bytes([b])] for b in reversed(chr(-2 - i).encode()))
                else:
                    ids.append(self.unknown)
                n = origin[n]
            ids.reverse()
            out[word] = tuple(ids)
            before = word if len(word) <= LONG else ""
        return out

    def _extend_unigram(self, word: str, last: list, n: int) -> None:
        best, found = None, None
        for size in range(min(n, self.longest), 0, -1):
            piece = word[n - size : n]
            v = self.score.get(piece, self.worst if size == 1 else None)
            if v is None:
                continue
            v += last[n - size][0]
            if best is None or v > best:
                best, found = v, piece
        last.append((best, found))

    def _encode_unigram(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        last: list = [(0.0, None)]
        out: dict[str, tuple[int, ...]] = {}
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                self._extend_unigram(word, last, n)
            ids: list[int] = []
            n = len(word)
            while n:
                piece = last[n][1]
                if piece in self.id:
                    ids.append(self.id[piece])
                elif self.fallback:
                    ids.extend(self.bytes[bytes([b])] for b in reversed(piece.encode()))
                else:
                    ids.append(self.unknown)
                n -= len(piece)
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, in the order given."""
        distinct = sorted(set(words))
        out = self._encode_bpe(distinct) if self.kind == _BPE else self._encode_unigram(distinct)
        return [out[w] for w in words]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return _WORD.findall(MARK + marked if self.dummy else marked)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        if self.dummy and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_codecs: dict[str, tuple[PieceCodec, Memo]] = {}


def codec_for(path: str) -> tuple[PieceCodec, Memo]:
    """A worker's codec for a model and its memo of words."""
    if path not in _codecs:
        codec = PieceCodec(path)
        _codecs[path] = codec, Memo(codec.encode_words, cost=lambda ids: 60 + 8 * len(ids))
    return _codecs[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec, memo = codec_for(path)
    for batch in batches:
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        split = [codec.words(t) for t in texts]
        value = memo(set().union(*split)) if split else {}
        ids = [np.fromiter(chain.from_iterable(map(value.__getitem__, w)), dtype=np.int32) for w in split]
        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))], names=["doc_id", "n_tokens", "ids"]
        )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec, _ = codec_for(path)
    for batch in batches:
        rows = column(batch, "ids").to_pylist()
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([codec.decode(r or ()) for r in rows], type=pa.string())], names=["doc_id", "text"])


def _check(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode and decode in one pass: what _encode gives, with the decoded text's bytes and whether it is the text again."""
    codec, _ = codec_for(path)
    for batch in batches:
        for out in _encode(iter([batch]), path):
            told = []
            for t, ids in zip(column(batch, "text").to_pylist(), out.column(2)):
                told.append(codec.decode(ids.values.to_numpy().tolist()) if len(ids) else "")
            same = [a == (t or "").replace(MARK, " ") for a, t in zip(told, column(batch, "text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([len(a.encode()) for a in told], type=pa.int64()), pa.array(same, type=pa.bool_())], names=[*out.schema.names, "n_bytes", "round_trip"]
            )


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids: one row per row of docs, as the library encodes the whole text.

    path: a SentencePiece model that must be there on every executor. No begin or end ids are added. Null and empty texts have no ids; repeated rows
    are encoded each. Other columns are ignored.
    """
    return _texts(docs).mapInArrow(lambda it: _encode(it, path), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text. Null and empty lists give an empty text; control ids give nothing; bytes that
    aren't UTF-8 give U+FFFD; a mark that stood in the original text comes back as a space."""
    prepare(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lambda it: _decode(it, path), "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """encode(), with n_bytes of the decoded text and round_trip: whether it equals the text, U+2581 (which decodes to a space) counting as a space. Cases as there."""
    return _texts(docs).mapInArrow(lambda it: _check(it, path), "doc_id long, n_tokens long, ids array<int>, n_bytes long, round_trip boolean")
