"""Connected components as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, saved


#: Edges up to which a join of them all is small, whatever the hubs; such edges are written by tasks of that many, but by LEAST_TASKS at least.
SPLIT, TASK_EDGES, LEAST_TASKS = 500_000, 16_384, 8


def _min_of_neighbours(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")


def _with_least(e: DataFrame) -> DataFrame:
    """Edges with m, the least node their u knows; hubs meet theirs by broadcast."""
    return join_hot(e, _min_of_neighbours(e), ["u"], "degree")


def _large_star(e: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the least node it knows."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(_min_of_neighbours(down).select("u", F.col("m").alias("v")))


def _turned(e: DataFrame, changed: str) -> DataFrame:
    """Rows u, v, each once, with m, the least node u knows, and whether they were changed: one shuffle and sort for both."""
    by = Window.partitionBy("u").orderBy("v")
    known = e.withColumn("m", F.least("u", F.min("v").over(by))).withColumn("last_", F.lag("v").over(by)).withColumn(changed, F.max(changed).over(by))
    return known.where("last_ is null or last_ <> v").drop("last_")


def _round(e: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, after a large-star and a small-star step, and whether a step changed them: two shuffles. Every edge gives one edge."""
    e = e.withColumn("c", F.lit(False))
    both = _turned(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "c")), "c").where("v > u")
    large = both.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("c"))
    small, least = _turned(large, "c"), F.col("v") == F.col("m")
    return small.select(F.when(least, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("c") | ~least).alias("c"))


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """edges (u, v) of longs -> (node, component), the component being its least node. known: components of further edges, as an earlier call gave them.

    Alternates large-star and small-star steps until every edge is a leaf of a star. Beyond SPLIT edges minima are combined before they are
    shuffled, hubs meet their minimum by broadcast and each step is written; below that a step is one shuffle and each round is written. A lost executor costs one
    step at most. Nodes without edges don't appear; self-links, repeats and nulls are left out.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if known is not None:
        if e.isEmpty():
            return known
        e = e.unionByName(known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    mark = None
    n = e.count()
    while n and n <= SPLIT:
        e = saved(_round(e).coalesce(max(LEAST_TASKS, -(-n // TASK_EDGES))))
        n, c = e.agg(F.count("*"), F.bool_or("c")).first()
        e = e.drop("c")
        if not c:
            break
    while n > SPLIT:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        large = _large_star(e).distinct()
        e = saved(_small_star(saved(large)).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
