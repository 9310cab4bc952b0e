"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into subspaces of two components, each with up to 256 centroids; its row keeps a byte for each subspace and the length of what the centroids leave over
in each. An anchor's table of products with all centroids gives any row's score as a sum of look-ups; the row's true score differs from
it by no more than the sum of the anchor's length in a subspace times the row's residual there. Rows that these bounds rule out are never multiplied; the rest get exact integer scores.

Rows are cut into blocks of bounded size by a hash of their place, and each block is shuffled once; anchors, the narrow side, are replicated to the blocks and stream
through them. A first pass finds each anchor's positives and a second, with their scores, each positive's window; what blocks find is cut to the best of each
window before it is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, prepare, saved

#: Components of a subspace, centroids of one, and rounds of fitting them.
WIDTH, CENTROIDS, ROUNDS = 2, 256, 6
#: Rows, and components in them, that centroids are fitted on at most; every row is encoded.
SAMPLE, SAMPLE_VALUES = 8192, 1 << 22
#: Rows of a block, about, and those below which a block isn't cut for more tasks; rows that are scored together; anchors that are.
BLOCK_ROWS, LEAST_ROWS, SLICE_ROWS, ANCHORS = 1 << 17, 2048, 1 << 13, 32
#: Components of this size or more don't take part: products of two such rows might not fit in 64 bits.
LARGEST = float(1 << 18)
#: Bounds are widened by this share of the lengths' product, far above what rounding can take from a sum.
SLACK = 1e-9


def fit_centroids(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """(subspaces, CENTROIDS, WIDTH) by Lloyd's rounds from rows of the sample; a subspace with fewer distinct points repeats some."""
    rng = np.random.default_rng(seed)
    m = sample.shape[1] // WIDTH
    out = np.zeros((m, CENTROIDS, WIDTH))
    if not len(sample):
        return out
    for k in range(m):
        x = sample[:, k * WIDTH : (k + 1) * WIDTH]
        c = x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)].copy()
        for _ in range(ROUNDS):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=CENTROIDS)
            for j in range(WIDTH):
                c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], CENTROIDS) / np.maximum(n, 1), c[:, j])
        out[k] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def quantise(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte for each subspace) and residual norms of the rows of x; norms are rounded up."""
    m = len(centroids)
    codes, rest = np.zeros((len(x), m), dtype=np.uint8), np.zeros((len(x), m))
    for k in range(m):
        part = x[:, k * WIDTH : (k + 1) * WIDTH]
        codes[:, k] = _nearest(part, centroids[k])
        rest[:, k] = np.sqrt(((part - centroids[k][codes[:, k]]) ** 2).sum(axis=1))
    return codes, np.nextafter(rest.astype(np.float32), np.float32(np.inf))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of `width`, shorter ones filled up with zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(values), width))
    out[np.repeat(np.arange(len(values)), lengths), np.concatenate([np.arange(n) for n in lengths.tolist()] or [lengths])] = flat
    return out


class Block:
    """Rows of a block, sorted by label, with their codes and residual norms laid out by subspace."""

    def __init__(self, place, vec_id, label, ints, codes, rest, centroids):
        order = np.argsort(label, kind="stable")
        self.place, self.vec_id, self.label, self.ints = place[order], vec_id[order], label[order], ints[order]
        self.codes, self.rest = np.ascontiguousarray(codes[order].T), np.ascontiguousarray(rest[order].T.astype(np.float64))
        self.centroids = centroids
        self.length = np.sqrt((self.ints.astype(np.float64) ** 2).sum(axis=1))

    def bounds(self, anchors: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Look-up scores of rows a to b for each anchor, and how far from the true scores they may be."""
        m, width = len(self.centroids), WIDTH
        parts = anchors.reshape(len(anchors), m, width)
        table = np.einsum("amw,mcw->amc", parts, self.centroids)
        score = np.zeros((len(anchors), b - a))
        for k in range(m):
            score += table[:, k, :][:, self.codes[k, a:b]]
        off = np.sqrt((parts**2).sum(axis=2)) @ self.rest[:, a:b]
        return score, off + SLACK * (1 + np.sqrt((anchors**2).sum(axis=1))[:, None] * self.length[None, a:b])

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer scores of rows."""
        few = self.ints[rows]
        if np.abs(anchor).max(initial=0) * np.abs(few).max(initial=0) * max(1, len(anchor)) < 2**53:
            return (few @ anchor).astype(np.int64)
        return (few.astype(object) @ anchor.astype(np.int64).astype(object)).astype(np.int64)


def _best(score: np.ndarray, vec_id: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The n first by score (highest), vec_id, place."""
    if len(score) > 8 * n:  # ties of the n-th stay in
        least = np.partition(score, len(score) - n)[len(score) - n]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((place[some], vec_id[some], -score[some]))[:n]]
    return np.lexsort((place, vec_id, -score))[:n]


def _kth(values: np.ndarray, n: int) -> float:
    """The n-th highest of values; -inf if there are fewer."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -np.inf


class Finder:
    """The rows of one block that can be among the `most` first of a window, for a batch of anchors.

    counters: rows that bounds were computed for, and rows that were multiplied.
    """

    def __init__(self, block: Block, most: int):
        self.block, self.most = block, most
        self.seen = self.multiplied = 0

    def _scored(self, anchor: np.ndarray, own: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows but the anchor itself, with their exact scores."""
        rows = rows[self.block.place[rows] != own]
        self.multiplied += len(rows)
        return rows, self.block.exact(anchor, rows)

    def positives(self, anchors: np.ndarray, owns: np.ndarray, label: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first rows of `label` for each anchor, itself left out."""
        a, b = np.searchsorted(self.block.label, label, "left"), np.searchsorted(self.block.label, label, "right")
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(anchors)
        for s in range(a, b, SLICE_ROWS):
            e = min(s + SLICE_ROWS, b)
            score, off = self.block.bounds(anchors, s, e)
            self.seen += score.size
            at_least = score - off
            at_least[np.asarray(owns)[:, None] == self.block.place[None, s:e]] = -np.inf
            for i in range(len(anchors)):
                before = held[i][1]
                least = max(_kth(at_least[i], self.most), _kth(before, self.most))
                rows = s + np.flatnonzero(score[i] + off[i] >= least)
                held[i] = self._merged(held[i], self._scored(anchors[i], owns[i], rows))
        return held

    def windows(self, anchors: np.ndarray, owns: np.ndarray, label: int, highs: list[list[int]], share: tuple[int, int]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and each of its highs the first rows of other labels with scores from share of it to it."""
        a, b = np.searchsorted(self.block.label, label, "left"), np.searchsorted(self.block.label, label, "right")
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        held = [[none] * len(h) for h in highs]
        slices = [(s, min(s + SLICE_ROWS, end)) for begin, end in ((0, a), (b, len(self.block.label))) for s in range(begin, end, SLICE_ROWS)]
        for s, e in slices:
            score, off = self.block.bounds(anchors, s, e)
            self.seen += score.size
            for i, anchor in enumerate(anchors):
                at_least, at_most = score[i] - off[i], score[i] + off[i]
                lows = [-(-share[0] * high // share[1]) for high in highs[i]]
                may = np.zeros(e - s, dtype=bool)
                for j, (low, high) in enumerate(zip(lows, highs[i])):
                    if low <= high:
                        sure = at_least[(at_most <= high) & (at_least >= low)]
                        least = max(low, _kth(sure, self.most), _kth(held[i][j][1], self.most))
                        may |= (at_most >= least) & (at_least <= high)
                rows, true = self._scored(anchor, owns[i], s + np.flatnonzero(may))
                for j, (low, high) in enumerate(zip(lows, highs[i])):
                    inside = (true >= low) & (true <= high)
                    held[i][j] = self._merged(held[i][j], (rows[inside], true[inside]))
        return held

    def _merged(self, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first of two sets of rows with their scores."""
        rows, score = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
        first = _best(score, self.block.vec_id[rows], self.block.place[rows], self.most)
        return rows[first], score[first]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, centroids: np.ndarray) -> Iterator[tuple[Block, pa.Table]]:
    """(block, some of its anchors) from rows sorted by block and side; a block's rows (side 0) are held, its anchors (side 1) come in batches."""
    key, rows, block = None, [], None
    for batch in batches:
        keys, side = column(batch, "block").to_numpy(), column(batch, "side").to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if keys[a] != key:
                key, rows, block = keys[a], [], None
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if side[a] == 0:
                rows.append(part)
                continue
            if not rows:  # anchors alone: nothing to find
                continue
            if block is None:
                t = pa.concat_tables(rows).combine_chunks()
                get = lambda name: t.column(name).combine_chunks()
                n, m = t.num_rows, len(centroids)
                codes = np.frombuffer(b"".join(get("codes").to_pylist()), dtype=np.uint8).reshape(n, m)
                rest = np.frombuffer(b"".join(get("rest").to_pylist()), dtype=np.float32).reshape(n, m)
                block = Block(get("place").to_numpy(), get("vec_id").to_numpy(), get("label").to_numpy(), _matrix(get("ints"), width), codes, rest, centroids)
                rows = [None]
            yield block, part


def _batched(t: pa.Table, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(label, anchors, their places, highs) of anchors of one label, ANCHORS at most."""
    t = t.sort_by("label")
    label = t.column("label").to_numpy()
    x, place, highs = _matrix(t.column("ints").combine_chunks(), width), t.column("place").to_numpy(), t.column("highs").to_pylist()
    cuts = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
    for a, b in zip(cuts, cuts[1:]):
        for s in range(a, b, ANCHORS):
            e = min(s + ANCHORS, b)
            yield int(label[s]), x[s:e], place[s:e], highs[s:e]


_FOUND = "anchor long, nth int, place long, vec_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], padded: int, centroids: np.ndarray, most: int, share: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """The first of each block: positives if share is None (nth is 0), else of each high's window (nth is the high's number)."""
    for block, some in _blocks(batches, padded, centroids):
        finder = Finder(block, most)
        out: list[tuple[np.ndarray, ...]] = []
        for label, x, owns, highs in _batched(some, padded):
            if share is None:
                found = [[f] for f in finder.positives(x, owns, label)]
            else:
                found = finder.windows(x, owns, label, highs, share)
            for own, each in zip(owns.tolist(), found):
                for nth, (rows, score) in enumerate(each):
                    out.append((np.full(len(rows), own), np.full(len(rows), nth, dtype=np.int32), block.place[rows], block.vec_id[rows], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "nth", "place", "vec_id", "score"])


def _encoded(batches: Iterator[pa.RecordBatch], padded: int, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(column(batch, "ints"), padded)
        codes, rest = quantise(x, centroids)
        kept = ["place", "vec_id", "label", "ints", "block"]
        packed = [pa.array([r.tobytes() for r in part], type=pa.binary()) for part in (codes, rest)]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *packed], names=[*kept, "codes", "rest"])


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` first of each window over all blocks, with rank."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "place"))
    return found.withColumn("rank", order).where(F.col("rank") <= most)


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """place, vec_id, label, ints of the rows that take part: floor(scale * x) of each component x as a double.

    Rows with a null vec_id, label or vector, with a null or non-finite component, or with one that isn't below LARGEST, are left out.
    """
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding")).where(good & F.forall("embedding", fine))
    return rows.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", F.transform("embedding", lambda v: F.floor(v * scale).cast("int")).alias("ints"))


def mine(rows: DataFrame, every: int, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """rows as of integer_rows() -> anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id `every` divides. Scores are integer inner products; higher ones come first, ties by smaller vec_id. An anchor's positives are its first other
    rows of its label; a positive's negatives are the first rows of other labels with scores from share of the positive's to the positive's.
    A share of a negative score is above it, so those windows are empty.

    All is exact: bounds only rule out what can't be in a window. Rows of one vec_id are rows of their own, also as anchors. Vectors that are shorter than the longest
    count as filled up with zeros. Empty tables give no rows. Work grows with anchors times rows; memory doesn't grow.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = saved(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    padded = max(WIDTH, -(-width // WIDTH) * WIDTH)
    sample = rows.select("ints").orderBy(F.xxhash64("place")).limit(max(CENTROIDS, min(SAMPLE, SAMPLE_VALUES // padded))).toArrow() if n else None
    centroids = fit_centroids(_matrix(sample.column("ints").combine_chunks(), padded) if n else np.zeros((0, padded)))
    blocks = max(1, -(-n // BLOCK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS))
    cut = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")
    kinds = "place long, vec_id long, label long, ints array<int>, block int, codes binary, rest binary"
    held = saved(rows.withColumn("block", cut).mapInArrow(lambda it: _encoded(it, padded, centroids), kinds))
    anchors = rows.where(F.col("vec_id") % every == 0)

    def search(asked: DataFrame, most: int, part: tuple[int, int] | None) -> DataFrame:
        """asked (place, label, ints, highs) meets every block."""
        nothing = lambda kind: F.lit(None).cast(kind)
        left = held.select("block", F.lit(0).alias("side"), "place", "vec_id", "label", "ints", "codes", "rest", nothing("array<long>").alias("highs"))
        right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "place", F.lit(0).cast("long").alias("vec_id"), "label", "ints", "highs")
        met = left.unionByName(right.withColumns({"codes": nothing("binary"), "rest": nothing("binary")}))
        met = met.repartition(blocks, "block").sortWithinPartitions("block", "side")
        return met.mapInArrow(lambda it: _search(it, padded, centroids, most, part), _FOUND)

    near = saved(_first(search(anchors.withColumn("highs", F.lit(None).cast("array<long>")), positives, None), ["anchor"], positives))
    highs = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("h")).select("anchor", F.transform("h", lambda s: s["score"]).alias("highs"))
    asked = anchors.join(highs, anchors["place"] == highs["anchor"]).select("place", "label", "ints", "highs")
    found = _first(search(asked, negatives, share), ["anchor", "nth"], negatives)
    names = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = near.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["anchor", "nth"]).join(names, "anchor")
    return joined.select("anchor_id", "positive_id", (F.col("nth") + 1).alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score")
