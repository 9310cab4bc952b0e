"""Token ids as binary files of shuffled planes.

Documents are dealt by ranges of doc_id and sorted, so the files of the range partitions follow each other in ascending order. Each task encodes its texts and
writes files below a shared folder; a manifest row names a file that a task has finished. The manifest is a table that Spark commits, so what a lost or repeated
attempt has left is never read.

A file: header; chunks of BLOCK ids, each transposed into byte planes (all lowest bytes, then all second bytes) or bit planes, every plane compressed by
zstandard on its own and planes of zeros left out; the documents' ids and lengths; the chunk index with each plane's size and each
chunk's crc32; a footer that says where documents and index begin. A range of ids is read by seeking to its chunks alone.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, prepare, saved, shared_dir

#: Ids of a chunk; ids and documents after which a task begins a further file; the level of compression.
BLOCK, FILE_IDS, FILE_DOCS, LEVEL = 1 << 16, 1 << 24, 1 << 20, 3
#: Bytes of pieces and their ids in a generation of a worker's memo, what a piece costs besides, and the longest piece that is kept.
MEMO_BYTES, MEMO_ROW, KEPT_CHARS = 80 << 20, 190, 256
#: Bytes of ids in a batch that a reader returns.
OUT_BYTES = 4 << 20

MAGIC = b"IDPLANES"
#: magic, ids of a chunk, planes of a chunk, bits of a plane's unit (8: byte planes, 1: bit planes)
_HEAD = struct.Struct("<8sIHH")
#: where the documents and the index begin, chunks, documents, ids, crc32 of documents and index, magic
_FOOT = struct.Struct("<QQQQQI8s")
MANIFEST = "part int, seq int, file string, docs long, ids long, bytes long"

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below are letters in every version of Unicode that a tokenizer may be built with.
STABLE = "\u0528"
#: Words and their ends whose ids tell whether words may be looked up without the punctuation that ends them, and in small letters.
_HEADS = ["the", "Tokenizer", "UNRELATED", "x", "Straße", "naïve", "ÉCOLE", "ΣΊΣΥΦΟΣ", "日本語", "zqxjkv"]
_ENDS = ["", ",", ".", "'", "...", "!?", "***", "$$$", "-", "_", "&&&", ")\"", "<|", "|>"]
_TEXTS = ["a b", "the  quick brown\nfox", " lead and trail ", "line\n\nline", "New York", "1 000 000", "x = y + z;\n\treturn", "été à la plage", "日本 語 の"]


class Encoder:
    """Ids of texts as little-endian bytes, equal to the library's for the whole text, without special tokens added.

    A text is split at spaces and line feeds; ids of pieces that were seen lately come from a memo of two generations of bounded bytes. A new piece of letters
    and punctuation behind them is looked up as two; letters of ASCII go to the library's model directly if that is proven to be the same.
    Tokenizers that join words across white space are refused when they are loaded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        for text in _TEXTS:
            if b"".join(self.library(p) for p in pieces(text)) != self.library(text):
                raise ValueError(f"{path} joins words across white space, so its ids aren't those of its pieces")
        self.parts = all(self.library(h + e) == self.library(h) + (self.library(e) if e else b"") for h in _HEADS for e in _ENDS)
        self.small = all(self._model(h.lower()) == self.library(h) for h in _HEADS if h.isascii())
        self.memo, self.words = _Memo(self._piece), _Memo(self._word)

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _model(self, word: str) -> bytes:
        return np.array([t.id for t in self.tok.model.tokenize(word)], dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return self._model(word) if self.small and word.isascii() and word.islower() else self.library(word)

    def _piece(self, piece: str) -> bytes:
        head = piece.rstrip(PUNCTUATION)
        low = head.lower()
        if not self.parts or not (head.isalpha() and low.isalpha()) or not (head.isascii() or max(head) < STABLE):  # some small letters hold a mark
            return self.library(piece)
        word = low if self.small and head.isascii() else head
        return self.words[word] + self.words[piece[len(head) :]] if len(head) < len(piece) else self.words[word]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces(text)))

    def age(self) -> None:
        self.memo.age()
        self.words.age()


class _Memo(dict):
    """Values by key, made when first asked for; age() drops what wasn't asked for during a generation of MEMO_BYTES."""

    def __init__(self, make):
        self.make, self.held, self.old = make, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARS:
            self[key] = value
            self.held += MEMO_ROW + len(key) + len(value)
        return value

    def age(self) -> None:
        if self.held > MEMO_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0


def pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """The planes of ids, lowest first, up to the last that isn't zero. unit: bits of a plane's unit, 8 or 1."""
    top = int(ids.max(initial=0)).bit_length()
    if unit == 1:
        return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(top)]
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(raw[:, b]).tobytes() for b in range((top + 7) // 8)]


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    ids = np.zeros(n, dtype="<u4")
    if unit == 1:
        for b, plane in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n).astype("<u4") << np.uint32(b)
        return ids
    raw = ids.view(np.uint8).reshape(-1, 4)
    for b, plane in enumerate(planes):
        raw[:, b] = np.frombuffer(plane, dtype=np.uint8)
    return ids


class PlaneWriter:
    """One file, written front to back; holds one chunk, and 17 bytes a document."""

    def __init__(self, sink, dtype: np.dtype, unit: int):
        self.sink, self.dtype, self.unit = sink, dtype, unit
        self.most = 32 // unit
        self.z = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.sizes, self.sums = bytearray(), [], []
        self.names, self.known, self.lengths, self.ids, self.at = [], [], [], 0, _HEAD.size
        sink.write(_HEAD.pack(MAGIC, BLOCK, self.most, unit))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as bytes of dtype."""
        n = len(ids) // self.dtype.itemsize
        self.names.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(n)
        self.ids += n
        self.held += ids
        size = BLOCK * self.dtype.itemsize
        while len(self.held) >= size:
            self._chunk(bytes(self.held[:size]))
            del self.held[:size]

    def _chunk(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype=self.dtype).astype("<u4")
        packed = [self.z.compress(p) for p in to_planes(ids, self.unit)]
        for p in packed:
            self.sink.write(p)
        self.at += sum(map(len, packed))
        self.sizes.append([len(p) for p in packed] + [0] * (self.most - len(packed)))
        self.sums.append(zlib.crc32(ids.tobytes()))

    def close(self) -> int:
        """Write what is left; the file's size."""
        if self.held:
            self._chunk(bytes(self.held))
        docs = self.z.compress(np.array(self.names, dtype="<i8").tobytes() + np.array(self.lengths, dtype="<i8").tobytes() + np.array(self.known, dtype=np.uint8).tobytes())
        index = np.array(self.sizes, dtype="<u4").tobytes() + np.array(self.sums, dtype="<u4").tobytes()
        self.sink.write(docs + index + _FOOT.pack(self.at, self.at + len(docs), len(self.sums), len(self.names), self.ids, zlib.crc32(docs + index), MAGIC))
        self.sink.close()
        return self.at + len(docs) + len(index) + _FOOT.size


class PlaneFile:
    """One file, read by seeking: the index when it is opened, a chunk when it is asked for. Raises ValueError if bytes were changed or are missing."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        head, foot = self.source.read_at(_HEAD.size, 0), self.source.read_at(_FOOT.size, max(0, size - _FOOT.size))
        if len(head) < _HEAD.size or len(foot) < _FOOT.size or head[:8] != MAGIC or foot[-8:] != MAGIC:
            raise ValueError(f"{uri} is no file of id planes, or not all of one")
        _, self.block, self.most, self.unit = _HEAD.unpack(head)
        docs_at, index_at, self.chunks, self.n_docs, self.n_ids, check, _ = _FOOT.unpack(foot)
        rest = self.source.read_at(size - _FOOT.size - docs_at, docs_at)
        if zlib.crc32(rest) != check:
            raise ValueError(f"the index of {uri} doesn't match its checksum")
        self.uri, self.z = uri, zstandard.ZstdDecompressor()
        self._docs, index = rest[: index_at - docs_at], rest[index_at - docs_at :]
        self.sizes = np.frombuffer(index, dtype="<u4", count=self.chunks * self.most).reshape(-1, self.most).astype(np.int64)
        self.sums = np.frombuffer(index, dtype="<u4", offset=self.chunks * self.most * 4)
        self.offsets = _HEAD.size + np.r_[0, np.cumsum(self.sizes.sum(axis=1))]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and how many ids each has."""
        raw = self.z.decompress(self._docs)
        n = self.n_docs
        names, lengths, known = np.frombuffer(raw, dtype="<i8", count=n), np.frombuffer(raw, dtype="<i8", count=n, offset=8 * n), np.frombuffer(raw, dtype=np.uint8, offset=16 * n)
        return [v if k else None for v, k in zip(names.tolist(), known.tolist())], lengths

    def chunk(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        at, packed = 0, self.source.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        planes = []
        for size in self.sizes[k].tolist():
            if size:
                planes.append(self.z.decompress(packed[at : at + size]))
                at += size
        ids = from_planes(planes, n, self.unit)
        if zlib.crc32(ids.tobytes()) != self.sums[k]:
            raise ValueError(f"chunk {k} of {self.uri} doesn't match its checksum")
        return ids

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (b left out) of this file, from their chunks alone."""
        a, b = max(a, 0), min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, dtype="<u4")
        first = a // self.block
        return np.concatenate([self.chunk(k) for k in range(first, (b - 1) // self.block + 1)])[a - first * self.block : b - first * self.block]

    def texts(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id, ids as little-endian unsigned 32-bit integers) of each document; each chunk is read once."""
        names, lengths = self.documents()
        held, at, k = bytearray(), 0, 0
        for name, n in zip(names, lengths.tolist()):
            while len(held) < 4 * n:
                held += self.chunk(k).tobytes()
                k += 1
            yield name, at, bytes(held[: 4 * n])
            del held[: 4 * n]
            at += n

    def close(self) -> None:
        self.source.close()


_encoders: dict[str, Encoder] = {}


def _write(batches: Iterator[pa.RecordBatch], at: str, path: str, end_id: int | None, unit: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
    fs, folder = pafs.FileSystem.from_uri(at)
    fs.create_dir(folder, recursive=True)
    part, done, writer, name = TaskContext.get().partitionId(), [], None, ""
    for batch in batches:
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
            if writer is None:
                name = f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.planes"
                writer = PlaneWriter(fs.open_output_stream(f"{folder}/{name}"), encoder.dtype, unit)
            writer.add(doc_id, encoder.encode(text or "") + end)
            if writer.ids >= FILE_IDS or len(writer.names) >= FILE_DOCS:
                done.append((part, len(done), f"{at}/{name}", len(writer.names), writer.ids, writer.close()))
                writer = None
        encoder.age()
    if writer is not None:
        done.append((part, len(done), f"{at}/{name}", len(writer.names), writer.ids, writer.close()))
    if done:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done), kinds)], names=["part", "seq", "file", "docs", "ids", "bytes"])


def write_ids(docs: DataFrame, path: str, end_id: int | None = None, planes: str = "byte", at: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them as files of id planes; the manifest: one row a file (part, seq, file, docs, ids, bytes) and start, the ids before it.

    path: a tokenizer .json, there on every executor; no special tokens are added but end_id (if given) behind every document. planes: "byte" or "bit". at: the
    folder's URI, one that executors share (default: below spark.checkpoint.dir, cleared when the session ends).

    Documents stand in ascending order of doc_id over all files in order of (part, seq). Rows without an id come first; rows of one id follow each other in the
    order of their texts' hashes, and repeated rows are all written. Null texts count as empty. Empty tables give no files. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    at = (at or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}").rstrip("/")
    unit = {"byte": 8, "bit": 1}[planes]
    keys = ["doc_id", "digest", "place"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = saved(dealt.mapInArrow(lambda it: _write(it, at, path, end_id, unit), MANIFEST))
    before = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*held), kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    for batch in batches:
        for uri, start in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist()):
            file = PlaneFile(uri)
            for doc_id, at, ids in file.texts():
                held.append((doc_id, start + at, len(ids) // 4, ids))
                size += len(ids) + 64
                if size >= OUT_BYTES:
                    yield out()
                    held, size = [], 0
            file.close()
    if held:
        yield out()


def _one_a_task(manifest: DataFrame) -> DataFrame:
    """A file, or a few, for each task."""
    return manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files in a manifest: doc_id, start (ids before it), n_tokens, and ids as little-endian unsigned 32-bit integers."""
    return _one_a_task(manifest.select("file", "start")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def read_range(manifest: DataFrame, start: int, stop: int) -> DataFrame:
    """Ids start to stop (left out) of all files in a row, as (start, ids) for each file that holds some; no other chunks are read."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist()):
                file = PlaneFile(uri)
                ids = file.read(start - first, stop - first)
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array([max(first, start)], type=pa.int64()), pa.array([ids.tobytes()], type=pa.binary())], names=["start", "ids"])

    met = manifest.where((F.col("start") < stop) & (F.col("start") + F.col("ids") > start)).select("file", "start")
    return _one_a_task(met).mapInArrow(some, "start long, ids binary")
