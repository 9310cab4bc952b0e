"""Shard outputs that a run can be killed in: parts are written aside, named, and count only once a commit says so.

A shard's folder holds parts of JSON lines and, below _commits, one small file a part with its number of records. A part without a commit (its run was killed) is never
read; a part with another number of records than its commit, or with a line that is no whole record, is refused. So a run that goes on reads what is
committed, works on the tasks that are left and appends another part.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_bit
from ..tables import saved

#: Bits of a page of the filter, bits for each id, and pages up to which the filter is broadcast (4 KB each).
PAGE, BITS, PAGES = 32_768, 10, 2048


class ShardLog:
    """The output of one shard of a run."""

    def __init__(self, spark: SparkSession, directory: str, rank: int):
        self.spark, self.path = spark, f"{directory.rstrip('/')}/per_sample.rank{rank}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def commits(self) -> dict[str, int]:
        """Parts and their numbers of records."""
        at = self._at("_commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        told = (n.removesuffix(".json").rsplit("-", 1) for n in sorted(names) if n.endswith(".json"))
        return {part: int(n) for part, n in told}

    def append(self, records: DataFrame, order: str = "sample_index") -> int:
        """Write records as a further part and commit it; how many there were. No part for none."""
        part = f"part{len(self.commits()):06d}_{uuid.uuid4().hex}"
        records = saved(records)
        n = records.count()
        if n:
            records.orderBy(order).write.json(f"{self.path}/{part}")
            self._commit(part, n)
        return n

    def _commit(self, part: str, n: int) -> None:
        self._fs.mkdirs(self._at("_commits"))
        self._fs.create(self._at("_commits", f"{part}-{n}.json"), False).close()

    def restart(self) -> None:
        """Forget all that was written."""
        self._fs.delete(self._at(), True)

    def read(self, schema: T.StructType) -> DataFrame:
        """Committed records; running it raises where a line is no whole record, and reading raises where a part lacks some."""
        out = self.spark.createDataFrame([], schema)
        for part, n in self.commits().items():
            df = self.spark.read.schema(schema).option("mode", "FAILFAST").json(f"{self.path}/{part}")
            lines = self.spark.read.text(f"{self.path}/{part}").count()
            if lines != n:
                raise ValueError(f"{self.path}/{part} has {lines} records, not the {n} that were committed")
            out = out.unionByName(df)
        return out


def remaining_by_filter(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that have no record in done yet, as remaining() of evaluate.py.

    A Bloom filter of the finished ids is broadcast if it is no more than PAGES pages: tasks that it doesn't know are left over for certain and take no part in the join. The others are joined
    exactly. A NULL id counts as the text None, as it does in records.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    finished = saved(done.select(named(F.col(key)).alias("done_")).distinct())
    pages = max(1, -(-finished.count() * BITS // PAGE))
    asked = tasks.withColumn("key_", F.col(key).cast("string"))
    if pages > PAGES:
        return asked.join(finished, asked["key_"] == finished["done_"], "left_anti").drop("key_")
    page, bit = (lambda x: F.pmod(x, F.lit(pages)).cast("int")), (lambda x: F.pmod(F.shiftright(x, 32), F.lit(PAGE)).cast("long"))
    hashed = finished.select(F.xxhash64("done_").alias("x"))
    held = hashed.select(page(F.col("x")).alias("page_"), bit(F.col("x")).alias("bit_")).groupBy("page_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    x = F.xxhash64("key_")
    met = asked.withColumn("page_", page(x)).withColumn("bit_", bit(x)).join(F.broadcast(held), "page_", "left")
    known = met.withColumn("known_", F.coalesce(F.col("key_").isNotNull() & has_bit(F.col("bits_"), F.col("bit_")), F.lit(False))).drop("page_", "bit_", "bits_")
    sure = known.where("not known_")
    maybe = known.where("known_").join(finished, F.col("key_") == F.col("done_"), "left_anti")
    return sure.unionByName(maybe).drop("key_", "known_")


def describe(path: str, spark: SparkSession, **what) -> None:
    """A run's description as one JSON file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(what, indent=1).encode()))
    out.close()
