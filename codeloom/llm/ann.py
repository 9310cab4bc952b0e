"""Approximate nearest neighbours by balanced posting lists.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the least distance. Centroids come
from balanced clustering of a bounded sample (the cost of a cluster rises with its size) and stay in memory with a neighbour
graph; a best-first walk of that graph finds the lists near a vector. Every vector is indexed: it goes to its nearest list and, if it
lies on a boundary, to others at nearly the same distance that no chosen list hides. A query visits all lists whose
centroids are within a ratio of the nearest one's distance, however many they are; with exact=True it visits all.

Lists that lie together share a cell, which is what a task holds: a vector is sent once to each cell with a list of its own, a query once to each
cell with a list it visits, in the width of the input and with the numbers of those lists. There are as many cells as keep the cores
busy, or more if a cell's vectors would take over CELL_BYTES. Cells of more than a block are cut into blocks, and so are the
queries that visit one, so a vector that occurs often costs more tasks and not a longer one. Scores are exact, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, groups, maybe_broadcast, prepare, saved

#: Vectors the centroids may be fitted on, and their bytes; vectors a list should hold; the most lists.
SAMPLE, SAMPLE_BYTES, PER_LIST, MAX_LISTS = 20_000, 32 << 20, 160, 4096
#: Copies of a boundary vector at most, and how much farther than the nearest list's centroid a further one may be (squared distances).
COPIES, SPREAD = 4, 1.15
#: Lists a query visits at least, and the ratio of squared distances that prunes the others.
LEAST_VISITS, REACH = 8, 1.7
#: Bytes of a cell's vectors and of a block of one; queries of a block; vectors whose scores are held at once.
CELL_BYTES, BLOCK_BYTES, QUERY_BLOCK, ROWS = 64 << 20, 32 << 20, 2048, 2048
#: Bytes of vectors in a batch of placed rows, and queries whose distances to all centroids are held at once.
PLACED_BYTES, QUERY_ROWS = 8 << 20, 512
#: Found rows that a task holds before it cuts them to the best of each query.
BUFFER = 400_000
_LINKS, _BEAM = 16, 64


@dataclass
class Centroids:
    """points: (lists, d + 1); graph: the neighbours of each; top: the squared norm that all vectors are lifted to; cell: each list's cell."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    top: float
    cell: np.ndarray

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))
        return np.column_stack([x, more])

    def near(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances) of the k nearest centroids of each row, nearest first, by walking the graph."""
        n, total = len(x), len(self.points)
        k = min(k, total)
        beam = min(total, max(_BEAM, 2 * k))
        square = (self.points * self.points).sum(axis=1)
        own = (x * x).sum(axis=1)

        def distance(rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
            return np.maximum(0, own[rows][:, None] + square[lists] - 2 * np.einsum("nd,nkd->nk", x[rows], self.points[lists]))

        every = np.arange(n)
        seen = np.zeros((n, total), dtype=bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        dist = distance(every, ids)
        seen[:, self.entries] = True
        done = np.zeros(ids.shape, dtype=bool)
        live = every
        while len(live):
            open_ = np.where(done[live], np.inf, dist[live])
            pick = open_.argmin(axis=1)
            better = np.isfinite(open_[np.arange(len(live)), pick])
            live, pick = live[better], pick[better]
            if not len(live):
                break
            done[live, pick] = True
            reach = self.graph[ids[live, pick]]
            fresh = ~seen[live[:, None], reach]
            seen[live[:, None], reach] = True
            d = np.where(fresh, distance(live, reach), np.inf)
            all_ids = np.concatenate([ids[live], reach], axis=1)
            all_dist = np.concatenate([dist[live], d], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            width = min(beam, all_ids.shape[1])
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            if width > ids.shape[1]:
                more = width - ids.shape[1]
                ids = np.concatenate([ids, np.zeros((n, more), ids.dtype)], axis=1)
                dist = np.concatenate([dist, np.full((n, more), np.inf)], axis=1)
                done = np.concatenate([done, np.ones((n, more), bool)], axis=1)
            ids[live, :width] = np.take_along_axis(all_ids, order, 1)
            dist[live, :width] = np.take_along_axis(all_dist, order, 1)
            done[live, :width] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(dist[live, :width])
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list within reach of a query, or one of the nearest few."""
        square = (self.points * self.points).sum(axis=1)
        rows, lists = [], []
        for a in range(0, len(x), QUERY_ROWS):
            y = x[a : a + QUERY_ROWS]
            d = np.maximum(0, (y * y).sum(axis=1)[:, None] + square - 2 * y @ self.points.T)
            k = min(LEAST_VISITS, d.shape[1])
            r, found = np.nonzero(d <= np.maximum(reach * d.min(axis=1), np.partition(d, k - 1, axis=1)[:, k - 1])[:, None])
            rows.append(r + a)
            lists.append(found)
        return np.concatenate(rows), np.concatenate(lists)


def _cells(points: np.ndarray, most: int) -> np.ndarray:
    """The cell of each list: halves along the direction of the largest variance, down to `most` lists."""
    cell = np.zeros(len(points), dtype=np.int64)
    todo, n = [np.arange(len(points))], 0
    while todo:
        some = todo.pop()
        if len(some) <= most:
            cell[some] = n
            n += 1
            continue
        y = points[some] - points[some].mean(axis=0)
        order = some[np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return cell


def fit_centroids(x: np.ndarray, lists: int, top: float, cells: int = 1, seed: int = 5) -> Centroids:
    """Balanced clusters of the sample x (rows of d coordinates), shared out to about that many cells."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = Centroids(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), top, np.zeros(0, int))
    y = np.unique(c.lift(x), axis=0) if len(x) else np.zeros((1, 1))
    lists = max(1, min(lists, len(y)))
    points = y[rng.permutation(len(y))[:lists]].copy()
    weight = np.zeros(lists)
    for _ in range(12):
        near = np.empty(len(y), dtype=np.int64)
        scale = 0.0
        for a in range(0, len(y), 2048):
            d = (points * points).sum(axis=1)[None, :] - 2 * y[a : a + 2048] @ points.T
            near[a : a + 2048] = (d + weight).argmin(axis=1)
            scale += np.abs(d.min(axis=1) + (y[a : a + 2048] ** 2).sum(axis=1)).sum()
        size = np.bincount(near, minlength=lists)
        for j in range(y.shape[1]):
            total = np.bincount(near, weights=y[:, j], minlength=lists)
            points[:, j] = np.where(size > 0, total / np.maximum(size, 1), points[:, j])
        empty = np.flatnonzero(size == 0)
        points[empty] = y[rng.integers(0, len(y), len(empty))]
        weight += 0.15 * scale / len(y) * (size * lists / len(y) - 1)
        weight -= weight.min()
    links = min(_LINKS, lists - 1)
    graph = np.zeros((lists, max(1, links)), dtype=np.int64)
    for a in range(0, lists, 1024):
        d = (points * points).sum(axis=1)[None, :] - 2 * points[a : a + 1024] @ points.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if links:
            graph[a : a + 1024, :links] = np.argsort(d, axis=1, kind="stable")[:, :links]
    if lists > 2:  # a ring and a few chords keep the graph in one piece
        far = rng.permutation(lists)
        ring = np.empty(lists, dtype=np.int64)
        ring[far] = np.roll(far, 1)
        graph = np.column_stack([graph, np.roll(np.arange(lists), 1), ring])
    return Centroids(points, graph, np.unique(np.linspace(0, lists - 1, min(8, lists)).astype(int)), top, _cells(points, -(-lists // cells)))


def _matrix(col: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of doubles from vectors as bytes of numbers of a kind."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, dtype=kind).reshape(len(col), -1).astype(np.float64)


def _place(batches: Iterator[pa.RecordBatch], told, every: int, reach: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) -> (cell, id, query, lists, v): a vector's cells and lists in the index and, if it's a query, those it visits."""
    c: Centroids = told.value
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = column(batch, "vec_id").to_numpy()
        x = np.asarray(column(batch, "v").flatten()).astype(kind).reshape(n, -1)
        near, d = c.near(c.lift(x.astype(np.float64)), COPIES * 2)
        taken = np.zeros(near.shape, dtype=bool)
        taken[:, 0] = True
        for j in range(1, near.shape[1]):
            ok = (d[:, j] <= SPREAD * d[:, 0]) & (taken.sum(axis=1) < COPIES)
            for i in range(j):  # not behind a list that is taken already
                gap = ((c.points[near[:, i]] - c.points[near[:, j]]) ** 2).sum(axis=1)
                ok &= ~(taken[:, i] & (gap < 0.25 * d[:, j]))
            taken[:, j] = ok
        r, k = np.nonzero(taken)
        yield from _sent(c, ids, x, r, near[r, k], False)
        asks = np.flatnonzero(ids % every == 0)
        if len(asks):
            r, lists = c.visits(c.lift(x[asks].astype(np.float64), query=True), reach)
            yield from _sent(c, ids, x, asks[r], lists, True)


def _sent(c: Centroids, ids: np.ndarray, x: np.ndarray, who: np.ndarray, lists: np.ndarray, query: bool) -> Iterator[pa.RecordBatch]:
    """A row for each vector and cell among (who, lists), with the lists there."""
    cell = c.cell[lists]
    order = np.lexsort((lists, cell, who))
    who, lists, cell = who[order], lists[order].astype(np.int32), cell[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])]) if len(who) else np.zeros(0, dtype=int)
    bounds = np.r_[first, len(who)]
    step = max(1, PLACED_BYTES // (x.itemsize * x.shape[1]))
    for a in range(0, len(first), step):
        at = first[a : a + step]
        rows = [pa.array(cell[at]), pa.array(ids[who[at]]), pa.array(np.full(len(at), query)), pa.array([lists[bounds[k] : bounds[k + 1]].tobytes() for k in range(a, a + len(at))], type=pa.binary())]
        yield pa.RecordBatch.from_arrays([*rows, pa.array([x[k].tobytes() for k in who[at]], type=pa.binary())], names=["cell", "id", "query", "lists", "v"])


def _members(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of rows' lists as bytes."""
    raw = col.to_pylist()
    return np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw]), np.frombuffer(b"".join(raw), dtype=np.int32)


def _few_alike(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """rows without those whose vector `most` rows of smaller ids have, too: ties go to the smaller id, so they can't be found."""
    rows = rows[np.argsort(ids[rows], kind="stable")]
    raw = np.ascontiguousarray(x[rows] + 0.0)  # -0 counts as 0
    group = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows)) - np.searchsorted(group[order], group[order])
    return rows[place < most]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's first `top` by score and id, a vector that several cells hold counting once."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.ones(len(q), dtype=bool)
    once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[once], ids[once], score[once]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < top
    return q[keep], ids[keep], score[keep]


def _search(batches: Iterator[pa.RecordBatch], top: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (cell, i, j, id, query, lists, v) sorted by cell, i, j -> each query's best among the task's blocks, exact scores.

    What blocks find is held and cut to the best of each query; it goes out early if the queries alone fill the buffer.
    """
    held_rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_held = 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _best(*(np.concatenate(c) for c in zip(*held_rows)), top)

    names = ["query_id", "vec_id", "score"]
    for _, t in groups(batches, ["cell", "i", "j"]):
        query, ids = t.column("query").to_numpy(zero_copy_only=False), t.column("id").to_numpy()
        x = _matrix(t.column("v"), kind)
        row, lists = _members(t.column("lists"))
        order = np.argsort(lists, kind="stable")
        row, lists = row[order], lists[order]
        least = np.full(len(ids), -np.inf)  # what each query has found `top` of already
        for a, b in zip(*(lambda f: (f, np.r_[f[1:], len(lists)]))(np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])) if len(lists) else ((), ())):
            asks, mine = row[a:b][query[row[a:b]]], row[a:b][~query[row[a:b]]]
            if not len(asks) or not len(mine):
                continue
            mine = _few_alike(x, ids, mine, top + 1)
            for low in range(0, len(mine), ROWS):
                some = mine[low : low + ROWS]
                rough = x[asks] @ x[some].T
                rough[ids[asks][:, None] == ids[some][None, :]] = -np.inf
                finite = rough[np.isfinite(rough)]
                slack = 1e-9 * max(1.0, float(np.abs(finite).max())) if len(finite) else 0.0
                if len(some) >= top:
                    least[asks] = np.maximum(least[asks], np.partition(rough, len(some) - top, axis=1)[:, len(some) - top])
                r, k = np.nonzero((rough >= (least[asks] - slack)[:, None]) & np.isfinite(rough))
                r, k = asks[r], some[k]
                held_rows.append((ids[r], ids[k], (x[r] * x[k]).sum(axis=1)))
                n_held += len(r)
                if n_held > BUFFER:
                    held_rows = [cut()]
                    n_held = len(held_rows[0][0])
                    if n_held > BUFFER // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held_rows[0]], names=names)
                        held_rows, n_held = [], 0
    if held_rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cut()], names=names)


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id and v of the vectors that take part: not null, not empty, of the most frequent width, all finite and not all zero; and their numbers' kind."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id is not null and size(v) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    width = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (width.n if width else 0)), kind


def search(vectors: DataFrame, top: int = 20, every: int = 20, reach: float = REACH, exact: bool = False) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates all other rows. Nearness is the largest inner product in
    double precision, ties to the smaller vec_id; fewer candidates than `top` give fewer rows. reach: how many times the squared distance of
    the nearest centroid a list may have to be visited; exact: visit all lists, so that nothing is missed. Vectors that are null or empty, of
    another width than most, zero, or with null or non-finite components take no part. Rows of one id count once, with the least of
    their vectors. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x, number = usable(vectors)
    x = saved(x.groupBy("vec_id").agg(F.min("v").alias("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double"))
    n, most, width = x.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v").toArrow().column("v").combine_chunks()
    sample = np.asarray(sample.flatten()).astype(np.float64).reshape(-1, width)
    kind = {"float": "f4", "double": "f8"}[number]
    size = width * int(kind[1])
    lists = max(1, min(MAX_LISTS, n // PER_LIST, len(sample) // 4))
    cells = max(1, min(lists, max(2 * spark.sparkContext.defaultParallelism, -(-n * size // CELL_BYTES))))
    told = spark.sparkContext.broadcast(fit_centroids(sample, lists, most, cells))
    reach = float("inf") if exact else reach
    rows = saved(x.mapInArrow(lambda it: _place(it, told, every, reach, kind), "cell int, id long, query boolean, lists binary, v binary"))
    index, asks = rows.where("not query"), rows.where("query")
    block = max(1, BLOCK_BYTES // (8 * width))
    best = saved(_answers(index, asks, top, kind, block))
    few = asks.select("id").distinct().join(best.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < min(top, n - 1))
    short = saved(few.select("id"))
    if not short.isEmpty():  # their lists held too little: they visit all
        again = x.join(short, x.vec_id == short.id).select("vec_id", "v")
        again = again.mapInArrow(lambda it: _place(it, told, every, float("inf"), kind), rows.schema).where("query")
        best = best.join(short, best.query_id == short.id, "left_anti").unionByName(_answers(index, again, top, kind, block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _answers(index: DataFrame, asks: DataFrame, top: int, kind: str, block: int) -> DataFrame:
    """The best of every list that a query visits: each cell in blocks, against its queries in blocks."""
    rows = index.unionByName(asks)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count_if(~F.col("query")) / block).alias("held"), F.ceil(F.count_if("query") / QUERY_BLOCK).alias("asks")).where("held > 0 and asks > 0")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    tasks = rows.join(maybe_broadcast(sizes, MAX_LISTS), "cell").withColumn("other", F.explode(F.when(F.col("query"), all_("held")).otherwise(all_("asks"))))
    tasks = tasks.select(
        "cell", F.when(F.col("query"), F.col("other")).otherwise(mine("held")).alias("i"), F.when(F.col("query"), mine("asks")).otherwise(F.col("other")).alias("j"), "id", "query", "lists", "v"
    )
    found = tasks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lambda it: _search(it, top, kind), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
