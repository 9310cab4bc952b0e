"""Exact medians by selection: a few passes of bounded histograms in place of sorting or of holding a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

#: Cells of a histogram, and the largest number that a double holds.
CELLS, LARGEST = 1024, 1.7976931348623157e308


def _octave(v: Column) -> Column:
    """Which power of two v is of, negative numbers below positive ones: grows with v."""
    size = F.log2(F.abs(v)) + 1080
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def exact_medians(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row with the median of each value over all records, NULL if it has none; of an even number the mean of the two in the middle.

    The middle ranks of all columns are looked for at once. Each pass cuts the range that a rank is known to lie in into CELLS cells (by powers of two where it is wide), counts them and keeps the least and the largest of each;
    the cell that holds the rank, drawn in to its own least and largest, is the next range. A range of one number ends it. What is held is CELLS rows for each column and rank, whatever
    the number of records. NaN is left out; infinite values count as the largest numbers.
    """
    names = list(values)
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items()])
    long = records.select(F.explode(pairs).alias("x")).where("x.v is not null and not isnan(x.v)")
    long = saved(long.select("x.name", F.greatest(F.least("x.v", F.lit(LARGEST)), F.lit(-LARGEST)).alias("v")))
    whole = long.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middle = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    targets = saved(whole.select("name", F.explode(middle).alias("rank"), "lo", "hi").withColumn("left", F.col("rank")))
    while not (open_ := targets.where("lo < hi")).isEmpty():
        wide = _octave(F.col("hi")) - _octave(F.col("lo"))
        share = F.when(wide > 1, (_octave(F.col("v")) - _octave(F.col("lo"))) / wide).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        met = long.join(F.broadcast(open_), "name").where("v between lo and hi").withColumn("cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        cells = met.groupBy("name", "rank", "left", "cell").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("name", "rank").orderBy("cell"))
        next_ = cells.withColumn("upto", upto).where("left >= upto - c and left < upto").select("name", "rank", "lo", "hi", (F.col("left") - F.col("upto") + F.col("c")).alias("left"))
        targets = saved(targets.where("lo = hi").unionByName(next_))
    each = targets.groupBy("name").agg(F.avg("lo").alias("m"))
    return each.agg(*[F.max(F.when(F.col("name") == k, F.col("m"))).alias(k) for k in names])


def weighted_medians(counted: DataFrame, names: list[str]) -> DataFrame:
    """As exact_medians(), from how often each value is met: (name, value, n), equal values added up first."""
    net = counted.groupBy("name", "value").agg(F.sum("n").alias("n")).where("n > 0")
    by = Window.partitionBy("name")
    placed = net.select("name", "value", F.sum("n").over(by.orderBy("value")).alias("upto"), "n", F.sum("n").over(by).alias("all"))
    middle = F.array_distinct(F.array(F.expr("(all - 1) div 2"), F.expr("all div 2")))
    hit = placed.withColumn("rank", F.explode(middle)).where("rank >= upto - n and rank < upto")
    each = hit.groupBy("name").agg(F.avg("value").alias("m"))
    return each.agg(*[F.max(F.when(F.col("name") == k, F.col("m"))).alias(k) for k in names])
