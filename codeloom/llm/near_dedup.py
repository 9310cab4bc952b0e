"""MinHash near-deduplication by an LSH forest, with links confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles. Texts with equal sets (by a 128-bit digest) are one class, with the
   least id as representative; only representatives go on.
2. Forest: each tree has an order of its own over the MinHash signature: it begins with the tree's own `depth` values and goes on with those
   of the trees after it. A *region* is the rows that agree on those first values. A region larger than a block is parted along
   the tree's order, deeper and deeper, until every part fits one; rows that agree on the whole signature are candidates as they are.
   Within a part rows are sorted by the tree's order, and neighbours, which have the longest common prefixes, are tried first; a
   row is then compared only with rows that no chain of candidates joins to it yet. A pair is a candidate if enough bytes of
   the signatures agree (five standard deviations below the threshold). Only a spanning forest of candidates leaves a task.
3. Going deeper parts pairs at the threshold. The exact way for them: the rows of a parted region that candidates have not joined into one
   component meet after all, rows of its largest component only with the others, in blocks.
4. Connected candidates are a family. Full sets meet within families. A family larger than a block goes the same way: parts along the
   order of the signatures first, then only what confirmed links have not joined.
5. Components of confirmed links give the answer.

A link at the threshold is missed only if no tree puts the pair in one region or its signatures disagree
improbably: `depth` is the largest for which the first has a chance below 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, groups, join_hot, maybe_broadcast, prepare, saved
from .graph import connected_components

TREES = 24
#: Rows of a region, or of a family, that one task compares, and the shingles of the latter's sets; what is larger is parted.
REGION_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 512, 256, 4 << 20
#: Bytes of the signature, in a tree's order, by which parts of a region are told apart, round by round.
DEPTHS = (2, 4, 8, 16, 32, 64, 256)
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def depth_for(threshold: float, trees: int = TREES, miss: float = 1e-5) -> int:
    depth = 1
    while depth < 16 and (1 - threshold ** (depth + 1)) ** trees <= miss:
        depth += 1
    return depth


def _features(batches: Iterator[pa.RecordBatch], k: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.text_buffers(column(batch, "text"))
        w = K.words(buf, offs, K.NOT_SPACE)
        h, bounds = K.distinct_by_text(*K.shingles(w, k), batch.num_rows)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        at = bounds[some]
        regions = np.zeros((batch.num_rows, TREES), dtype=np.int64)
        sig = np.zeros((batch.num_rows, TREES * depth), dtype=np.uint8)
        digest = _digests(h, bounds)
        if len(some):
            for t in range(TREES):
                key = np.full(len(some), (t + 1) * int(_MULTIPLY[4000]) % 2**64, dtype=np.uint64)
                for j in range(t * depth, (t + 1) * depth):
                    low = np.minimum.reduceat(h * _MULTIPLY[j], at)
                    key = K.mix(key * _MULTIPLY[4001] + low)
                    sig[some, j] = (K.mix(low) & np.uint64(255)).astype(np.uint8)
                regions[some, t] = key.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array(digest[0]),
                pa.array(digest[1]),
                K.lists(regions.ravel(), np.arange(batch.num_rows + 1) * TREES, pa.int64()),
                pa.array([x.tobytes() for x in sig], type=pa.binary()),
            ],
            names=["doc_id", "n_shingles", "d1", "d2", "regions", "sig"],
        )


def _digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set of hashes."""
    out = np.zeros((2, len(bounds) - 1), dtype=np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for i in (0, 1):
            out[i, some] = np.add.reduceat(K.mix(h ^ _MULTIPLY[4090 + i]), bounds[some]).view(np.int64)
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.text_buffers(column(batch, "text"))
        h, bounds = K.distinct_by_text(*K.shingles(K.words(buf, offs, K.NOT_SPACE), k), batch.num_rows)
        sets = pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], type=pa.binary())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, _digests(h, bounds)), pa.array(np.diff(bounds).astype(np.int64)), sets], names=["doc_id", "d1", "d2", "n_shingles", "shingles"])


class _Forest:
    """Union-find over rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            self.join(x, y)


def forest_of(ids: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray, least_agree: int) -> tuple[list[tuple[int, int]], int]:
    """(edges of a spanning forest of the candidate pairs, pairs compared) among rows in a tree's order.

    Pairs have one row of left and one of right. Rows of one group count as joined; neighbours come first, and rows that are joined by then aren't compared.
    """
    label = np.unique(group, return_inverse=True)[1]
    edges: list[tuple[int, int]] = []
    compared = 0

    def join(x: int, y: int) -> None:
        if label[x] != label[y]:
            edges.append((int(ids[x]), int(ids[y])))
            label[label == label[y]] = label[x]

    meet = (left[1:] & right[:-1] | left[:-1] & right[1:]) & (label[1:] != label[:-1])
    at = np.flatnonzero(meet)
    compared += len(at)
    for x in at[np.count_nonzero(sig[at + 1] == sig[at], axis=1) >= least_agree].tolist():
        join(x, x + 1)
    place = np.arange(len(ids))
    for x in np.flatnonzero(left).tolist():
        fresh = right & (label != label[x])
        if right[x]:
            fresh &= ~left | (place > x)
        others = np.flatnonzero(fresh)
        compared += len(others)
        for y in others[np.count_nonzero(sig[others] == sig[x], axis=1) >= least_agree].tolist():
            join(x, y)
    return edges, compared


_TASK = ["key", "kind", "i", "j"]


def _pairs_table(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])


def _candidates(batches: Iterator[pa.RecordBatch], least_agree: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, i, j, rep, comp, left, right, ord) sorted by task -> a spanning forest of candidate pairs."""
    for _, rows in groups(batches, _TASK):
        if rows.num_rows < 2:
            continue
        raw = rows.column("ord").to_pylist()
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__))
        ids, comp, left, right = (rows.column(c).to_numpy(zero_copy_only=False)[order] for c in ("rep", "comp", "left", "right"))
        sig = np.frombuffer(b"".join(raw[i] for i in order.tolist()), dtype=np.uint8).reshape(len(raw), -1)
        edges, _ = forest_of(ids, comp, left, right, sig, least_agree)
        if edges:
            yield _pairs_table(edges)


def _confirmed(batches: Iterator[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, i, j, rep, comp, left, right, shingles) sorted by task -> a spanning forest of exact links."""
    for _, rows in groups(batches, _TASK):
        if rows.num_rows < 2:
            continue
        ids, comp, left, right = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "left", "right"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[code] > 1  # what one text alone has meets nothing
        owner, code = owner[shared], code[shared]
        rank = np.cumsum(count > 1) - 1
        code = rank[code]
        total = int(rank[-1]) + 1
        low, high = np.flatnonzero(left), np.flatnonzero(right)
        meet = np.zeros((len(low), len(high)), dtype=np.int64)
        by_code = np.argsort(code, kind="stable")
        owner, code = owner[by_code], code[by_code]
        step = 4096
        for at in range(0, total, step):  # columns in bounded runs, whose sums single precision holds exactly
            a, b = np.searchsorted(code, (at, at + step))
            m = np.zeros((len(ids), min(step, total - at)), dtype=np.float32)
            m[owner[a:b], code[a:b] - at] = 1
            meet += (m[low] @ m[high].T).astype(np.int64)
        both = size[low][:, None] + size[high][None, :] - meet
        x, y = np.nonzero((denominator * meet >= numerator * both) & (comp[low][:, None] != comp[high][None, :]))
        forest = _Forest(len(ids))
        forest.join_all(low[x], high[y])
        if forest.edges:
            yield _pairs_table([(int(ids[a]), int(ids[b])) for a, b in forest.edges])


def _parted(rows: DataFrame, block: int, weight: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (key, n_rows, n_weight, w, ord, ...) with the part of their key that one task compares, and the keys that were parted.

    A key of up to `block` rows and `weight` in all is one part. Others are parted by longer and longer prefixes of `ord`; parts too large at
    full length have `whole` set.
    """
    fits = (F.col("n_rows") <= block) & (F.col("n_weight") <= weight)
    rows = rows.withColumn("part", F.col("key")).withColumn("whole", F.lit(False))
    done, rest = rows.where(fits), saved(rows.where(~fits))
    if rest.isEmpty():
        return done, None
    over = saved(rest.select("key").distinct())
    for depth in DEPTHS:
        rest = rest.drop("n_rows", "n_weight").withColumn("part", F.xxhash64("key", F.substring("ord", 1, depth)))
        sizes = rest.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("w").alias("n_weight"))
        rest = saved(join_hot(rest, sizes, ["part"], "n_rows"))
        done, rest = done.unionByName(rest.where(fits), allowMissingColumns=True), rest.where(~fits)
        if rest.isEmpty():
            return done, over
    return done.unionByName(rest.withColumn("whole", F.lit(True))), over


def _within(rows: DataFrame) -> DataFrame:
    """Tasks of parts that are compared as they are."""
    flag = F.lit(True)
    return rows.withColumns({"key": F.col("part"), "kind": F.lit(0), "i": F.lit(0), "j": F.lit(0), "comp": F.col("rep"), "left": flag, "right": flag})


def _across(rows: DataFrame, components: DataFrame, block: int, weight: int) -> DataFrame:
    """Tasks of keys whose rows (key, rep, w, ...) lie in several components: all pairs of different ones, in blocks.

    Rows of a key's largest component meet the others' blocks only; a key of one component has no task.
    """
    rows = saved(rows.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("w").alias("v"))
    most = F.max(F.struct("n", "v", "comp")).alias("m")
    keys = per.groupBy("key").agg(most, F.sum("n").alias("n_rows"), F.sum("v").alias("n_weight"), F.count("*").alias("c")).where("c > 1")
    blocks = lambda n, v: F.greatest(F.ceil(n / block), F.ceil(v / weight)).cast("int")
    keys = keys.select(
        "key", F.col("m.comp").alias("main"), "n_rows", blocks(F.col("m.n"), F.col("m.v")).alias("held"), blocks(F.col("n_rows") - F.col("m.n"), F.col("n_weight") - F.col("m.v")).alias("asks")
    )
    rows = join_hot(rows, saved(keys), ["key"], "n_rows").withColumn("is_main", F.col("comp") == F.col("main"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("held")).otherwise(F.col("asks"))).cast("int")
    rows = rows.withColumn("block", mine)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    b = F.col("block")
    task = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    no, yes = F.lit(False), F.lit(True)
    with_main = F.transform(upto("held"), lambda k: task(1, k, b, no, yes))
    with_asks = F.transform(upto("asks"), lambda k: task(2, F.least(b, k), F.greatest(b, k), b <= k, b >= k))
    tasks = F.when(F.col("is_main"), F.transform(upto("asks"), lambda k: task(1, b, k, yes, no))).otherwise(F.concat(with_main, with_asks))
    return rows.withColumn("t", F.explode(tasks)).select("*", "t.*").drop("t", "block", "held", "asks", "main", "is_main", "n_rows")


def _dealt(tasks: DataFrame, *payload: str) -> DataFrame:
    return tasks.select(*_TASK, "rep", "comp", "left", "right", *payload).repartition(*_TASK).sortWithinPartitions(*_TASK)


def _candidate_families(reps: DataFrame, depth: int, least_agree: int) -> DataFrame:
    """reps (rep, n_shingles, sig, regions) -> (node, component) of the representatives that candidates join."""
    placed = saved(reps.select("rep", F.posexplode("regions").alias("tree", "key")))
    shared = placed.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    met = join_hot(placed, shared, ["key"], "n_rows").join(reps.select("rep", "sig"), "rep")  # only these rows carry a signature onwards
    first = F.col("tree") * depth
    turned = F.concat(F.substring("sig", first + 1, F.length("sig") - first), F.substring("sig", F.lit(1), first))
    met = saved(met.select("key", "rep", "n_rows", F.col("n_rows").alias("n_weight"), F.lit(1).alias("w"), turned.alias("ord")))
    parts, over = _parted(met, REGION_BLOCK, REGION_BLOCK)
    seek = partial(_candidates, least_agree=least_agree)
    near = _dealt(_within(parts.where("not whole")), "ord").mapInArrow(seek, "u long, v long")
    if over is None:
        return connected_components(near)
    same = parts.where("whole").select("part", "rep")
    least = same.groupBy("part").agg(F.min("rep").alias("v"), F.count("*").alias("n"))
    equal = join_hot(saved(same), saved(least), ["part"], "n").select(F.col("rep").alias("u"), "v")
    joined = connected_components(near.unionByName(equal))
    rows = met.join(maybe_broadcast(over, over.count()), "key", "left_semi").select("key", "rep", "w", "ord")
    more = _dealt(_across(rows, joined, REGION_BLOCK, REGION_BLOCK), "ord").mapInArrow(seek, "u long, v long")
    return connected_components(more, joined)


def _linked(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """rows (key, rep, w, ord, shingles), key being the family -> (node, component) of exact links."""
    confirm = partial(_confirmed, numerator=numerator, denominator=denominator)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("w").alias("n_weight"))
    parts, over = _parted(join_hot(rows, sizes, ["key"], "n_rows"), FAMILY_BLOCK, FAMILY_SHINGLES)
    links = _dealt(_within(parts.where("not whole")), "shingles").mapInArrow(confirm, "u long, v long")
    if over is None:
        return connected_components(links)
    # equal signatures, different sets: pieces that share the least row
    same = parts.where("whole").withColumn("pieces", F.greatest(F.ceil(F.col("n_rows") / FAMILY_BLOCK), F.ceil(F.col("n_weight") / FAMILY_SHINGLES)).cast("int"))
    same = saved(same)
    least = same.groupBy("part").agg(F.min("rep").alias("pivot"), F.count("*").alias("n"))
    same = join_hot(same, saved(least), ["part"], "n")
    piece = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")))
    pieces = _within(same).withColumn("i", F.explode(piece))
    joined = connected_components(links.unionByName(_dealt(pieces, "shingles").mapInArrow(confirm, "u long, v long")))
    rows = rows.join(maybe_broadcast(over, over.count()), "key", "left_semi")
    more = _dealt(_across(rows, joined, FAMILY_BLOCK, FAMILY_SHINGLES), "shingles").mapInArrow(confirm, "u long, v long")
    return connected_components(more, joined)


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (80, 100), shingle: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, one row per document.

    threshold (numerator, denominator): documents are linked if denominator * intersection >= numerator * union of
    their sets of distinct `shingle`-word shingles (A-Z folded, words ended by 0x20 and 0x09-0x0D). component_id is the
    least doc_id reachable by links; kept marks it. Null and empty texts have no shingles and stay alone; texts of fewer
    words are one shingle; repeated rows of one doc_id are one document, and one row returns (of several
    texts under one id the one whose set has the least digest counts); rows whose doc_id is null don't return. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    top, bottom = threshold
    share = top / bottom
    depth = depth_for(share)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    schema = "doc_id long, n_shingles long, d1 long, d2 long, regions array<long>, sig binary"
    rows = saved(docs.mapInArrow(partial(_features, k=shingle, depth=depth), schema))
    alike = ["d1", "d2", "n_shingles"]
    ids = rows.groupBy("doc_id").agg(F.min(F.struct(*alike)).alias("low"), F.max(F.struct(*alike)).alias("high"), F.count("*").alias("n_rows"))
    several = saved(ids.where("low <> high").select("doc_id", "low", "n_rows"))
    if not several.isEmpty():
        rows = saved(join_hot(rows, several, ["doc_id"], "n_rows", "left").where(F.col("low").isNull() | (F.col("low") == F.struct(*alike))).drop("low", "n_rows"))
    classes = saved(rows.where("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_members")))
    first = classes.select(F.col("rep").alias("doc_id"), *alike)
    reps = rows.join(first, ["doc_id", *alike], "left_semi").dropDuplicates(["doc_id"])

    hashes = TREES * depth
    agree = share + (1 - share) / 256
    least_agree = math.floor(hashes * agree - 5 * math.sqrt(hashes * agree * (1 - agree)))
    reps = saved(reps.select(F.col("doc_id").alias("rep"), *alike, "sig", "regions"))
    families = _candidate_families(reps, depth, least_agree).select(F.col("node").alias("rep"), F.col("component").alias("key"))

    held = saved(families.join(reps.select("rep", *alike, F.col("sig").alias("ord")), "rep"))
    wanted = maybe_broadcast(held.select(F.col("rep").alias("doc_id")), held.count())
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(partial(_sets, k=shingle), "doc_id long, d1 long, d2 long, n_shingles long, shingles binary")
    sets = saved(held.join(sets.withColumnRenamed("doc_id", "rep"), ["rep", *alike]).dropDuplicates(["rep"]).select("key", "rep", F.col("n_shingles").alias("w"), "ord", "shingles"))
    found = _linked(sets, top, bottom).select(F.col("node").alias("rep"), "component")

    told = saved(classes.join(found, "rep", "left").select(*alike, "n_members", F.coalesce("component", "rep").alias("component")))
    out = join_hot(rows.select("doc_id", *alike), told, alike, "n_members", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.dropDuplicates(["doc_id"]).withColumn("kept", F.col("doc_id") == F.col("component_id"))
