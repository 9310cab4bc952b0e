"""Readers that plan before they read: archives and source trees as Spark data sources.

Planning lists names and sizes only, of an archive its central directory, and leaves out what isn't a supported file. Partitions are runs of the files or members left,
of bounded bytes, so a large archive is read by many tasks and many small ones by one; each is read by seeking to it, and nothing else is read.
"""

from __future__ import annotations

import bz2
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SOURCE = "repository string, relative_path string, file_extension string, language string, content string, error string"
_ARROW = pa.schema([(c.split()[0], pa.string()) for c in SOURCE.split(", ")])
#: Stored bytes and files of a partition, bytes of text in a batch, archives whose directories are read at a time.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES, AT_ONCE = 64 << 20, 4096, 8 << 20, 16
_LOCAL = struct.Struct("<4s22xHH")


def decode_text(data: bytes) -> str:
    """UTF-8, invalid bytes dropped, line ends as in text mode."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def suffix(path: str) -> str:
    """The last path part's extension; none for names that begin with their only dot."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:] if dot > 0 else ""


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and its path there; raises ValueError for kinds that pyarrow doesn't serve."""
    try:
        return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    except pa.ArrowInvalid as e:
        raise ValueError(str(e)) from e


def list_files(directory: str, extensions) -> list[str]:
    """Paths of the files below a directory with one of the extensions, letter case counted, in order."""
    fs, path = open_fs(directory)
    return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and suffix(i.path) in set(extensions))


@dataclass(frozen=True)
class Item:
    """A file, or an archive's member: what a task needs to read it. error: what is wrong with the whole archive."""

    repository: str
    relative_path: str | None
    file: str
    size: int
    offset: int = 0
    method: int = -1
    crc: int = 0
    encrypted: bool = False
    error: str | None = None


@dataclass
class Part(InputPartition):
    items: list[Item] = field(default_factory=list)

    def __init__(self, items: list[Item]):
        super().__init__(len(items))
        self.items = items


def parts_of(items: list[Item], most: int, files: int) -> list[Part]:
    """Runs of items of at most that many bytes and files, or of one."""
    out, held, size = [], [], 0
    for item in items:
        if held and (size + item.size > most or len(held) >= files):
            out.append(Part(held))
            held, size = [], 0
        held.append(item)
        size += item.size
    return [*out, Part(held)] if held else out


class _Reader(DataSourceReader):
    """Options: path, languages (a JSON object of languages by extension), partitionBytes, partitionFiles, repository (of source trees)."""

    def __init__(self, options):
        self.path, self.known = options["path"], json.loads(options["languages"])
        self.most, self.files = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("partitionFiles", PARTITION_FILES))
        self.repository = options.get("repository", "")

    def items(self, fs: pafs.FileSystem, path: str) -> list[Item]:
        raise NotImplementedError

    def partitions(self) -> list[Part]:
        fs, path = open_fs(self.path)
        return parts_of(self.items(fs, path), self.most, self.files) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        rows, size, held, name = [], 0, None, None
        for item in partition.items:
            extension = suffix(item.relative_path or "")
            try:
                if item.error:
                    raise ValueError(item.error)
                if item.file != name:
                    if held is not None:
                        held.close()
                    held, name = fs.open_input_file(item.file), item.file
                text = decode_text(_bytes_of(held, item))
                rows.append((item.repository, item.relative_path, extension, self.known[extension], text, None))
                size += len(text)
            except Exception as e:  # what is damaged is a row, not a failed job
                rows.append((item.repository, None, None, None, None, f"{item.relative_path}: {e}"[:200] if item.relative_path else str(e)[:200]))
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if held is not None:
            held.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*rows)], schema=_ARROW)


def _bytes_of(file: pa.NativeFile, item: Item) -> bytes:
    """A plain file as a whole; a member from behind its local header, checked against its crc32."""
    if item.method < 0:
        return file.read_at(file.size(), 0)
    if item.encrypted:
        raise ValueError("encrypted member")
    mark, n_name, n_extra = _LOCAL.unpack(file.read_at(_LOCAL.size, item.offset))
    if mark != b"PK\x03\x04":
        raise ValueError("no member where the directory says")
    packed = file.read_at(item.size, item.offset + _LOCAL.size + n_name + n_extra)
    if len(packed) < item.size:
        raise ValueError("the archive ends within a member")
    if item.method == zipfile.ZIP_STORED:
        data = packed
    elif item.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(packed, -zlib.MAX_WBITS)
    elif item.method == zipfile.ZIP_BZIP2:
        data = bz2.decompress(packed)
    else:
        raise ValueError(f"compression method {item.method} isn't served")
    if zlib.crc32(data) != item.crc:
        raise ValueError("a member doesn't match its checksum")
    return data


class _Archives(_Reader):
    def items(self, fs: pafs.FileSystem, path: str) -> list[Item]:
        infos = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        zips = sorted(i.path for i in infos if i.is_file and i.path.endswith(".zip"))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [item for items in pool.map(lambda p: self._members(fs, p), zips) for item in items]

    def _members(self, fs: pafs.FileSystem, path: str) -> list[Item]:
        repo = path.rsplit("/", 1)[-1][: -len(".zip")]
        try:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                found = [m for m in z.infolist() if not m.is_dir() and suffix(m.filename) in self.known]
        except Exception as e:
            return [Item(repo, None, path, 0, error=str(e) or type(e).__name__)]
        inner = lambda name: name.split("/", 1)[1] if "/" in name else name
        return [Item(repo, inner(m.filename), path, m.compress_size, m.header_offset, m.compress_type, m.CRC, bool(m.flag_bits & 1)) for m in found]


class _Tree(_Reader):
    def items(self, fs: pafs.FileSystem, path: str) -> list[Item]:
        infos = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        root = path.rstrip("/") + "/"
        return [Item(self.repository, i.path.removeprefix(root), i.path, i.size) for i in sorted(infos, key=lambda i: i.path) if i.is_file and suffix(i.path) in self.known]


class ArchiveSource(DataSource):
    """spark.read.format("codeloom_archives"): supported members of a folder's *.zip files, or of one."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_archives"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema) -> DataSourceReader:
        return _Archives(self.options)


class TreeSource(DataSource):
    """spark.read.format("codeloom_tree"): supported files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_tree"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema) -> DataSourceReader:
        return _Tree(self.options)
