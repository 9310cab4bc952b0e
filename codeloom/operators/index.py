"""Inverted indexes of fingerprints: who holds what, without the units themselves.

Stored: postings in segments, cut into buckets by a hash of the fingerprint, so a retrieval reads the buckets that its queries ask for and nothing else. A segment holds signed postings, +1
where a unit has gained a fingerprint and -1 where it has lost one. How much a query shares with a unit is a sum over postings, so signs add up by themselves and an
upsert only writes what it changed; merge() folds segments into one. Beside each segment stands how often its commonest fingerprints are met.

Scanned: the same for a DataFrame that is used once. Its fingerprints are computed and written once and exploded where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import saved
from .scan import where_equal

#: Buckets of an index, unless its table says otherwise.
BUCKETS = 256
#: Units from which a fingerprint counts as frequent in a segment.
FREQUENT = 512
#: Rows of exploded queries up to which they are broadcast to the postings (a row takes about 60 bytes).
BROADCAST_ROWS = 200_000

POSTING = "h string, id bigint, sign int, language string, repository string"
#: As written: 16 hex digits are kept as their 8 bytes, any other text behind 9 zero bytes.
_WRITTEN = "h binary, id bigint, sign int, language string, repository string"
_OTHER = "\0" * 9

# The order of kinds at equal merit.
KIND_PRIORITY = {"declaration_block": 0, "function": 1, "method": 2, "global": 3, "type": 4}
OTHER_KIND = 99


def kind_priority(kind: Column) -> Column:
    out = F.lit(OTHER_KIND)
    for k, p in KIND_PRIORITY.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def line_span(start: Column, end: Column) -> Column:
    """Lines between start and end, never below 0; a missing or zero end counts as the start."""
    a = F.coalesce(start, F.lit(0))
    return F.greatest(F.lit(0), F.when(F.coalesce(end, F.lit(0)) == 0, a).otherwise(end) - a)


def tie() -> Column:
    """The total order among candidates of equal merit."""
    return F.struct(
        kind_priority(F.col("kind")).alias("kp"),
        line_span(F.col("start_line"), F.col("end_line")).alias("span"),
        F.coalesce("qualified_name", F.lit("")).alias("name"),
        F.col("id").alias("id"),
    )


def bucket_of(h: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(buckets)).cast("int")


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return rows.limit(most + 1).count() <= most


def _told(h: Column) -> Column:
    return F.when(F.octet_length(h) == 8, F.lower(F.hex(h))).otherwise(F.decode(F.substring(h, len(_OTHER) + 1, 2**31 - 1), "UTF-8"))


class Scanned:
    """The index of a DataFrame of units for one fingerprint column, within a scope.

    alike: of units with equal fingerprints the first that many by the order of ties are enough. No retrieval of up to that many units needs others, as all of them share
    the same with any query. Where that leaves at most half of the units, the others are left out, so what queries meet follows the different fingerprints.
    """

    def __init__(self, kb: DataFrame, fingerprint: str, language: str | Sequence[str] | None = None, repository: str | None = None, alike: int | None = None):
        self.every = where_equal(kb, language, repository)
        own = saved(self.every.select(tie().alias("t"), F.array_distinct(fingerprint).alias("own")))
        if alike:
            same = own.where("own is not null").select("t", F.md5(F.to_json("own").cast("binary")).alias("same"))
            place = F.row_number().over(Window.partitionBy("same").orderBy("t"))
            first = saved(same.withColumn("place", place).where(F.col("place") <= alike).select(F.col("t.id").alias("first_")))
            if 2 * first.count() <= own.count():
                own = saved(own.join(F.broadcast(first) if few(first) else first, F.col("t.id") == F.col("first_"), "left_semi"))
        self._own = own

    def hits(self, asked: DataFrame, told: bool) -> DataFrame:
        """asked (query_id, h) -> query_id, h, id, sign of the units that hold h. told: asked is small enough to be broadcast."""
        units = self._own.select(F.col("t.id").alias("id"), F.explode("own").alias("h"), F.lit(1).alias("sign"))
        return units.join(F.broadcast(asked) if told else asked, "h")

    def frequent(self, asked: DataFrame) -> DataFrame | None:
        """(h, n) of frequent fingerprints; None: not known without counting, so none is set apart."""
        return None

    def ties(self) -> DataFrame:
        """(id, t) of every unit."""
        return self._own.select(F.col("t.id").alias("id"), "t")

    def first(self, n: int) -> DataFrame:
        """t of the n first units by the order of ties that have a fingerprint."""
        return self._own.where("own is not null").select("t").orderBy("t").limit(n)


class Stored:
    """The index of a stored table for one fingerprint column, within a scope; reads the buckets that are asked for."""

    #: How many times the units that are wanted are looked through for some with a fingerprint.
    SPARE = 4

    def __init__(self, units: DataFrame, segments: Sequence[str], buckets: int, exists, fingerprint: str, language: str | Sequence[str] | None = None, repository: str | None = None):
        """units: the table; segments: their folders; exists: tells whether a folder is there."""
        self.spark, self.every = units.sparkSession, where_equal(units, language, repository)
        self.segments, self.buckets, self.exists, self.fingerprint = segments, buckets, exists, fingerprint
        self._scope = lambda df: where_equal(df, language, repository)

    def folders(self, asked: DataFrame) -> list[str]:
        """The bucket folders that the asked fingerprints are in; there are no more of them than buckets times segments."""
        wanted = sorted(r[0] for r in asked.select(bucket_of("h", self.buckets)).distinct().collect())
        return [at for s in self.segments for b in wanted if self.exists(at := f"{s}/postings/bucket={b}")]

    def hits(self, asked: DataFrame, told: bool) -> DataFrame:
        at = self.folders(asked)
        rows = self.spark.read.schema(_WRITTEN).parquet(*at).withColumn("h", _told(F.col("h"))) if at else self.spark.createDataFrame([], POSTING)
        return self._scope(rows).select("h", "id", "sign").join(F.broadcast(asked) if told else asked, "h")

    def frequent(self, asked: DataFrame) -> DataFrame | None:
        at = [f"{s}/frequent" for s in self.segments]
        if not at:
            return None
        return self.spark.read.schema("h string, n long").parquet(*at).groupBy("h").agg(F.sum("n").alias("n")).join(asked.select("h").distinct(), "h", "left_semi")

    def ties(self) -> DataFrame:
        return self.every.select("id", tie().alias("t"))

    def first(self, n: int) -> DataFrame:
        """Looked for among the first SPARE * n of all units, whose fingerprints alone are read; only if that leaves fewer than n is the whole scope ordered."""
        bare = F.col(self.fingerprint).isNull()
        front = saved(self.every.select(tie().alias("t")).orderBy("t").limit(self.SPARE * n))
        some = self.every.join(F.broadcast(front.select(F.col("t.id").alias("id"))), "id", "left_semi").select(tie().alias("t"), bare.alias("bare"))
        first = saved(saved(some).where("not bare").select("t").orderBy("t").limit(n))  # written first, or the filter would go below the join
        if first.count() < n and front.count() == self.SPARE * n:
            first = self.every.where(~bare).select(tie().alias("t")).orderBy("t").limit(n)
        return first


def write_segment(rows: DataFrame, at: str, buckets: int) -> None:
    """Postings, as written, as a segment: buckets with equal fingerprints together, those of hot fingerprints split by Spark's rebalancing, and the frequent ones' counts."""
    spark = rows.sparkSession
    cut = rows.withColumn("bucket", bucket_of(_told(F.col("h")), buckets)).hint("rebalance", "bucket")
    # Equal fingerprints come together by a number, which is sorted without comparisons, and so are buckets by the writer, stably; the filter, which all rows pass, keeps Spark from dropping the first sort.
    together = cut.withColumn("x", F.xxhash64("h")).sortWithinPartitions("x").where(F.monotonically_increasing_id() >= 0).drop("x")
    together.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/postings")
    frequent = _written(spark, [at]).groupBy("h").agg(F.sum("sign").alias("n")).where(F.col("n") >= FREQUENT)
    frequent.withColumn("h", _told(F.col("h"))).write.parquet(f"{at}/frequent")


def _written(spark: SparkSession, segments: Iterable[str]) -> DataFrame:
    return spark.read.schema(_WRITTEN).option("recursiveFileLookup", "true").parquet(*[f"{s}/postings" for s in segments])


def merge(spark: SparkSession, segments: Iterable[str], at: str, buckets: int) -> None:
    """All segments as one: what was gained and lost again is gone."""
    net = _written(spark, segments).groupBy("h", "id", "language", "repository").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
    write_segment(net.select("h", "id", "sign", "language", "repository"), at, buckets)
