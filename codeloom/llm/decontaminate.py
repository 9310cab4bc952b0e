"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by the token windows of every document.

Test items become windows of `n` consecutive words (an item of fewer words is one window), hashed to 64 bits. The hash set goes
to every worker with a bitmap that answers most probes at once. Documents are scanned batch by batch; a probe
that hits is confirmed on the words themselves. Nothing of the documents is shuffled.

The set is cut into blocks of bounded size (`BLOCK_BYTES` of item text); each block is broadcast and scanned on its own, and only
documents with hits are then merged. One block, the usual case, needs no merge.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, digested, maybe_broadcast, prepare, same_row, saved, without

#: Text of items in one broadcast block: its windows take about ten times as much.
BLOCK_BYTES = 8 << 20
_SCHEMA = "doc_id long, n_words long, spans array<struct<first: int, last: int, start: int, end: int>>, items array<long>"


class WindowSet:
    """Windows of test items: by length, sorted hashes with their words and the items they come from."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        texts = pa.array([t for _, t in items], type=pa.large_string())
        buf, offs = K.text_buffers(texts)
        w = K.words(buf, offs, K.ALNUM)
        folded = K.LOWER[buf]
        found: dict[int, dict[int, dict[bytes, set[int | None]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for k in range(len(items)):
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            if b == a:
                continue
            size = min(n, b - a)
            for j, h in enumerate(K.window_hashes(w.hash[a:b], size).tolist()):
                found[size][h][words_at(folded, w, a + j, size)].add(items[k][0])
        self.lengths = []
        for size, by_hash in sorted(found.items()):
            hashes = np.array(sorted(by_hash), dtype=np.uint64)
            bits = max(16, int(64 * len(hashes)).bit_length())
            seen = np.zeros(1 << bits, dtype=bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.lengths.append((size, hashes, bits, seen, [{k: sorted(v, key=_id_order) for k, v in by_hash[h].items()} for h in hashes.tolist()]))


def _id_order(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def words_at(folded: np.ndarray, w: K.Words, at: int, size: int) -> bytes:
    return b" ".join(folded[s:e].tobytes() for s, e in zip(w.start[at : at + size].tolist(), w.end[at : at + size].tolist()))


def _scan(batches: Iterator[pa.RecordBatch], windows) -> Iterator[pa.RecordBatch]:
    known: WindowSet = windows.value
    for batch in batches:
        texts = column(batch, "text")
        buf, offs = K.text_buffers(texts)
        w = K.words(buf, offs, K.ALNUM)
        folded = None
        items: dict[int, set[int | None]] = defaultdict(set)
        marks = np.zeros(len(w.start) + 1, dtype=np.int32)
        text_of = w.text_of
        for size, hashes, bits, seen, told in known.lengths:
            h = K.window_hashes(w.hash, size)
            at = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            at = at[text_of[at] == text_of[at + size - 1]]
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            real = hashes[place] == h[at]
            folded = K.LOWER[buf] if folded is None and real.any() else folded
            for i, p in zip(at[real].tolist(), place[real].tolist()):
                who = told[p].get(words_at(folded, w, i, size))
                if who:
                    marks[i] += 1
                    marks[i + size] -= 1
                    items[int(text_of[i])].update(who)
        hit = np.cumsum(marks[:-1]) > 0
        # runs of hit words within one text
        first = hit.copy()
        first[1:] &= ~(hit[:-1] & (text_of[1:] == text_of[:-1]))
        last = hit.copy()
        last[:-1] &= ~(hit[1:] & (text_of[1:] == text_of[:-1]))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        base_word, base_byte = w.bounds[text_of[a]], offs[text_of[a]]
        spans = pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int32)) for x in (a - base_word, b + 1 - base_word, w.start[a] - base_byte, w.end[b] - base_byte)], names=["first", "last", "start", "end"]
        )
        bounds = np.searchsorted(text_of[a], np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"),
                pa.array(np.diff(w.bounds).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds), spans),
                pa.array([sorted(items.get(i, ()), key=_id_order) for i in range(batch.num_rows)], type=pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_words", "spans", "items"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()):
            if text is not None and spans:
                raw, at, kept = text.encode(), 0, []
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, "text", pa.array(out, type=pa.string()))


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = 10, digest: bool = False) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id [, digest], n_words, spans, items: one row per row of docs.

    spans are the runs of hit words: word positions [first, last) and byte offsets [start, end) of the text; items are the
    sorted ids of items with a window in the text. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z folded. Null
    and empty texts have no words; items without words have no windows; items whose id is null or no number are found
    like others and stand together as one null at the end of items (n_items counts it, the joined ids leave it out); repeated rows are scanned each; an empty benchmark hits
    nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = digested(docs)
    items = benchmark.select(F.col("item_id").try_cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-int(total) // BLOCK_BYTES) or 1
    kind = "long"
    if blocks > 1 or digest:  # hits of several blocks meet by id and text, so repeated rows of one id keep their own
        docs, kind = docs.select(F.struct("doc_id", "digest").alias("doc_id"), "text"), "struct<doc_id: long, digest: long>"
    schema = _SCHEMA.replace("doc_id long", f"doc_id {kind}")
    found = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        known = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.text) for r in mine.toLocalIterator()], n))
        found.append(docs.mapInArrow(lambda it, known=known: _scan(it, known), schema))
    out = found[0] if blocks == 1 else _merged(docs, found, schema)
    told = ["doc_id.doc_id", "doc_id.digest"] if digest else ["doc_id.doc_id" if blocks > 1 else "doc_id"]
    return out.select(*told, "n_words", "spans", "items")


def _merged(docs: DataFrame, found: list[DataFrame], schema: str) -> DataFrame:
    """Hits of several blocks as one row a document; doc_id is a struct of the id and its text's digest."""
    counts = docs.mapInArrow(lambda it: _scan(it, _Empty()), schema).select("doc_id", "n_words")
    hits = found[0].where("size(spans) > 0")
    for f in found[1:]:
        hits = hits.unionByName(f.where("size(spans) > 0"))
    by_doc = hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    run = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<first: int, last: int, start: int, end: int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"),
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    none = F.expr("cast(array() as array<struct<first: int, last: int, start: int, end: int>>)")
    by_doc = by_doc.select(F.col("doc_id").alias("at"), run.alias("spans"), "items")
    return counts.join(by_doc, counts.doc_id.eqNullSafe(by_doc["at"]), "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items")
    )


class _Empty:
    """Stands for a broadcast set without windows."""

    def __init__(self):
        self.value = WindowSet([], 1)


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Cases as in find_windows()."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return find_windows(docs, benchmark, n).select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut out of their texts.

    Columns other than text stay as they are, whatever their names. Each row is judged by its own text, also where ids repeat or are null;
    null and empty texts stay. An empty benchmark removes nothing.
    """
    found = find_windows(docs, benchmark, n, digest=True).where("size(spans) > 0").select("doc_id", "digest", "spans")
    if remove == "documents":
        return without(docs, found).select(*docs.columns)
    found = saved(found.dropDuplicates(["doc_id", "digest"]))
    told = maybe_broadcast(found, found.count(), 64)
    held = docs.join(told, same_row(docs, found), "left").select(docs["text"].cast("string").alias("text"), found["spans"].alias("spans"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    cut = held.mapInArrow(_cut, held.schema)
    return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
