"""What the operators share: reading tables, bounded Arrow batches, saved intermediate tables, grouped streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker; a longer text makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20
#: A key is hot if it has more than both HOT_ROWS rows and one HOT_SHARE-th of all.
HOT_ROWS, HOT_SHARE = 256, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds, so a worker's memory follows the longest text and not the mean one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none: one of our own if driver and executors share a machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _clear_at_exit(spark)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row a key and in `count` how many rows have that key.

    Keys with over a HOT_SHARE-th of all rows (and over HOT_ROWS) meet by broadcast: there are fewer than HOT_SHARE of them
    whatever the data, so their size is bounded, and no other key can make a task of the shuffled join a long one.
    rows are read twice, so they should be a saved table.
    """
    total, most = side.agg(F.sum(count), F.max(count)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if not most or most <= least:
        return rows.join(side, keys, how)
    few, others = side.where(F.col(count) > least), side.where(F.col(count) <= least)
    told = F.broadcast(few)
    return rows.join(told, keys).unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(others, keys, how))


_clearing: set[str] = set()


def _clear_at_exit(spark: SparkSession) -> None:
    at = shared_dir(spark)
    if at in _clearing:
        return
    _clearing.add(at)

    def clear() -> None:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        if jsc is not None:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(clear)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than that many rows; reads no more than are needed to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int = 16, most: int = 4 << 20) -> DataFrame:
    """df marked for broadcast if `rows`, its counted size, is proven small; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= most else df


def digested(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a digest of the text: id and digest tell rows apart where ids repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("digest"))


def same_row(docs: DataFrame, found: DataFrame):
    """The condition that a row of docs and one of found (doc_id, digest) are of one id and one text; nulls are equal."""
    return docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["digest"])


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows of found (doc_id, digest), which is broadcast if counted small."""
    found = saved(found.select("doc_id", "digest").distinct())
    return docs.join(maybe_broadcast(found, found.count(), 32), same_row(docs, found), "left_anti")


def but(batch: pa.RecordBatch, *names: str) -> tuple[list[pa.Array], list[str]]:
    """Columns and names of a batch without those named."""
    kept = [n for n in batch.schema.names if n not in names]
    return [column(batch, n) for n in kept], kept


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_chunks(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes each, or of one row."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in a stream sorted by them; a group's rows are held together, so callers bound group sizes."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].item() for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)
