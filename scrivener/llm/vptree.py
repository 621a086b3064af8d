"""Nearest neighbours by vantage-point trees, one a shard.

A node of the tree holds a vantage point and the median distance of the rest to it;
what is nearer goes inside and what is farther outside. A query skips a side when the
triangle inequality shows that nothing there is nearer than its k-th candidate so far.
``relax`` multiplies the gap that is shown: at 1 the search is exact, above 1 it skips
more and may miss some.

Shards are the leaves of a vantage-point tree over a sample of ``SAMPLE`` points, and
every point goes to one. The distances of its points to the vantage points above it bound
a shard. A query searches its own shard first; the distance of the k-th neighbour found
there decides by the same inequality which other shards it is sent to. Within a task a
shard's points come before its queries, so a tree is built once and queries stream past
it: memory grows with neither table, and points are never copied.

Equal vectors are one point with its smallest identifiers, of which a list of k can
never need more than k + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import shuffle_partitions, stored

K = 10
#: 1 is exact. Above it, more of each tree and more shards are skipped.
RELAX = 1.0
SHARD_ROWS = 8192
#: Points that the shards' boundaries are learned from, and shards of one vector length that boundaries tell apart; a larger shard is divided by hash.
SAMPLE, MAX_CELLS = 1 << 14, 1 << 12
LEAF = 64
QUERY_EVERY = 100
#: Slack for rounding in bounds, relative to the distances they come from.
SLACK = 1e-9


def _spread(points: np.ndarray, rows: np.ndarray) -> int:
    """Of a few of the rows, the one whose distances to others spread most: it tells them apart best."""
    some = points[rows[:: max(1, len(rows) // 100)]]
    picks = rows[:: max(1, len(rows) // 5)][:5].tolist()
    return max(picks, key=lambda r: (float(np.var(_distances(points[r : r + 1], some)[0])), -r))


class VantagePointTree:
    """A tree over the rows of ``points``, searched by many queries at once."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        # nodes: (rows of a leaf) or (vantage row, median distance, inside, outside)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.leaf:
            self.nodes[at] = (rows,)
            return at
        vantage = _spread(self.points, rows)
        rest = rows[rows != vantage]
        off = _distances(self.points[vantage : vantage + 1], self.points[rest])[0]
        order = np.argsort(off, kind="stable")
        half = len(rest) // 2
        middle = float(off[order[half]])
        inside, outside = rest[order[:half]], rest[order[half:]]
        self.nodes[at] = (vantage, middle, self._build(np.sort(inside)), self._build(np.sort(outside)))
        return at

    def search(self, queries: np.ndarray, k: int, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of each query's k nearest points; row -1 where there are fewer."""
        self.found = np.full((len(queries), k), -1, np.int64)
        self.off = np.full((len(queries), k), np.inf)
        self._visit(self.root, np.arange(len(queries)), queries, relax)
        return self.found, self.off

    def _offer(self, who: np.ndarray, rows: np.ndarray, off: np.ndarray) -> None:
        k = self.off.shape[1]
        off = np.concatenate((self.off[who], off), axis=1)
        rows = np.concatenate((self.found[who], np.broadcast_to(rows, (len(who), len(rows)))), axis=1)
        best = np.argsort(off, axis=1, kind="stable")[:, :k]
        self.off[who] = np.take_along_axis(off, best, axis=1)
        self.found[who] = np.take_along_axis(rows, best, axis=1)

    def _visit(self, at: int, who: np.ndarray, queries: np.ndarray, relax: float) -> None:
        if not len(who):
            return
        node = self.nodes[at]
        if len(node) == 1:
            if len(node[0]):
                self._offer(who, node[0], _distances(queries[who], self.points[node[0]]))
            return
        vantage, middle, inside, outside = node
        off = _distances(queries[who], self.points[vantage : vantage + 1])
        self._offer(who, np.array([vantage]), off)
        off = off[:, 0]
        near = off < middle
        gap = (np.abs(off - middle) - SLACK * (off + middle)) * relax
        for side, first, second in ((near, inside, outside), (~near, outside, inside)):
            self._visit(first, who[side], queries, relax)
            open_ = side & (gap <= self.off[who, -1])
            self._visit(second, who[open_], queries, relax)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class Cells:
    """The upper tree, whose leaves are shards: learned from a sample, applied to all."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.vantages: list[np.ndarray] = []
        # nodes: a cell's number, or (vantage, distance, inside, outside)
        self.nodes: list = []
        self.paths: list[list[int]] = []
        self._build(sample, cells, [])
        self.points = np.array(self.vantages).reshape(len(self.vantages), sample.shape[1])
        depth = max(map(len, self.paths))
        self.above = np.array([p + [-1] * (depth - len(p)) for p in self.paths], np.int64).reshape(len(self.paths), depth)
        #: Distances of each cell's points to the vantage points above it.
        self.low, self.high = np.zeros(self.above.shape), np.full(self.above.shape, np.inf)

    def _build(self, sample: np.ndarray, cells: int, path: list[int]) -> int:
        at = len(self.nodes)
        if cells <= 1 or len(sample) < 2:
            self.nodes.append(len(self.paths))
            self.paths.append(path)
            return at
        self.nodes.append(None)
        vantage = len(self.vantages)
        self.vantages.append(sample[_spread(sample, np.arange(len(sample)))])
        off = _distances(self.vantages[-1][None], sample)[0]
        half = cells // 2
        middle = float(np.sort(off)[len(off) * half // cells])
        inside = off < middle
        down = [*path, vantage]
        self.nodes[at] = (vantage, middle, self._build(sample[inside], half, down), self._build(sample[~inside], cells - half, down))
        return at

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                inside = _distances(points[rows], self.points[node[0]][None])[:, 0] < node[1]
                stack += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return out

    def path_distances(self, points: np.ndarray, cells: np.ndarray) -> list[list[float]]:
        """Of each point, its distances to the vantage points above its cell."""
        out: list = [None] * len(points)
        for c in np.unique(cells):
            rows = np.flatnonzero(cells == c)
            for r, d in zip(rows.tolist(), _distances(points[rows], self.points[self.paths[c]]).tolist() if self.paths[c] else [[]] * len(rows), strict=True):
                out[r] = d
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least distance that each cell's points can have from each query."""
        if not len(self.points):
            return np.zeros((len(queries), len(self.paths)))
        off = np.append(_distances(queries, self.points), np.zeros((len(queries), 1)), axis=1)
        out = np.zeros((len(queries), len(self.paths)))
        for level in range(self.above.shape[1]):
            here = self.above[:, level]
            d = off[:, here]
            slack = SLACK * (d + np.where(np.isfinite(self.high[:, level]), self.high[:, level], 0))
            gap = np.maximum(d - self.high[:, level], self.low[:, level] - d) - slack
            out = np.maximum(out, np.where(here >= 0, gap, 0))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) for x in batch.column(at)])
    for n in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == n)))


def _placed(cells):
    """Points (v, ids) with dim, cell and the distances to the vantage points above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 0) if whole.num_rows else ():
                points = _matrix(batch.column(0))
                tree = cells.value.get(points.shape[1])
                cell = tree.assign(points) if tree else np.zeros(len(points), np.int64)
                path = tree.path_distances(points, cell) if tree else [[]] * len(points)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([points.shape[1]] * len(points), pa.int32()), pa.array(cell), pa.array(path, pa.list_(pa.float64()))], ["v", "ids", "dim", "cell", "path"])

    return run


def _routed(cells, relax: float):
    """Queries (qid, id, v, far) to cells: to their own where ``far`` is null, else to the others that may hold a nearer point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 2) if whole.num_rows else ():
                asked = _matrix(batch.column(2))
                far = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                tree = cells.value.get(asked.shape[1])
                home = tree.assign(asked) if tree else np.zeros(len(asked), np.int64)
                first = np.isnan(far)
                to = [(np.flatnonzero(first), home[first])]
                for i in range(0, len(asked) if tree else 0, 256):
                    part = np.arange(i, min(i + 256, len(asked)))[~first[i : i + 256]]
                    near = tree.bounds(asked[part]) * relax <= far[part, None] * (1 + SLACK)
                    near[np.arange(len(part)), home[part]] = False
                    q, c = np.nonzero(near)
                    to.append((part[q], c))
                rows, cell = (np.concatenate(x) for x in zip(*to, strict=True))
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([asked.shape[1]] * len(rows), pa.int32()), pa.array(cell.astype(np.int64))], ["qid", "id", "v", "dim", "cell"])

    return run


class _Shard:
    """A tree over one shard's points and what is asked of it."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        # points in order of their smallest identifier
        order = sorted(range(len(ids)), key=lambda r: ids[r][0])
        self.ids = [ids[r] for r in order]
        self.tree = VantagePointTree(vectors[order])
        self.alone: dict[int, int] = {}
        for x in self.ids:
            if len(x) == 1:
                self.alone[x[0]] = self.alone.get(x[0], 0) + 1

    def nearest(self, asked: np.ndarray, own: list[int], k: int, relax: float) -> Iterator[tuple[int, int, float]]:
        """(place in ``asked``, identifier, distance) of each query's k nearest; not those of its own identifier."""
        size = len(self.ids)
        # one more than needed: where that is as near as the last, there may be others, and all of them are looked at
        slots = min(k + 1 + max(self.alone.get(i, 0) for i in own), size)
        rows, off = self.tree.search(asked, slots, relax)
        for n, (q, ident, found, dist) in enumerate(zip(asked, own, rows, off, strict=True)):
            found = found[found >= 0]
            counts = np.cumsum([len(self.ids[r]) - (ident in self.ids[r]) for r in found])
            enough = int(np.searchsorted(counts, k))
            last = dist[min(enough, len(found) - 1)]
            if len(found) < size and dist[len(found) - 1] <= last * (1 + SLACK):
                every = np.nonzero(np.abs(_distances(q[None], self.tree.points)[0] - last) <= SLACK * last)[0]
                found = np.union1d(found, every)
            # sums in order of the components, as a loop over them would
            exact = np.sqrt(np.cumsum((self.tree.points[found] - q) ** 2, axis=1)[:, -1])
            for s, i in sorted((float(s), i) for s, r in zip(exact, found, strict=True) for i in self.ids[r] if i != ident)[:k]:
                yield n, i, s


def _searched(k: int, relax: float):
    """Rows (dim, cell, sub, qid, id, v, ids), sorted so that a shard's points (qid null) come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, shard = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1).astype(np.int64)
            query = np.asarray(batch.column(3).is_valid())
            marks = np.concatenate((keys, query[:, None]), axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if tuple(keys[i]) != at:
                    at, vectors, ids, shard = tuple(keys[i]), [], [], None
                if not query[i]:
                    vectors.append(_matrix(part.column(5)))
                    ids += part.column(6).to_pylist()
                    continue
                if not ids:
                    continue  # a part of a shard without points
                if shard is None:
                    shard, vectors = _Shard(np.concatenate(vectors), ids), []
                found = list(shard.nearest(_matrix(part.column(5)), part.column(4).to_pylist(), k, relax))
                of = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(3).take(of), part.column(4).take(of), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["qid", "id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    relax: float = RELAX,
    query_every: int = QUERY_EVERY,
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """The k nearest rows of each row whose identifier is divisible by ``query_every``.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in double
    precision), nearest first, ties to the smaller identifier; all candidates if there
    are fewer than k. Defined cases: vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do null identifiers; vectors are compared
    with those of their own length only; rows that repeat an identifier are candidates
    once for each different vector, and never for a query of that identifier; other
    columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    rows = stored(rows, "vectors")
    kind = dict(rows.dtypes)["v"]
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = stored(rows.withColumn("n", place).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    # one row a length of vectors
    lengths = {r["dim"]: r["count"] for r in points.groupBy(F.size("v").alias("dim")).count().collect()}
    some: dict[int, list] = {}
    for r in points.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect():
        some.setdefault(len(r["v"]), []).append(r["v"])
    trees = {dim: Cells(np.array(vs, np.float64), min(MAX_CELLS, -(-lengths[dim] // shard_rows))) for dim, vs in some.items()}
    cells = spark.sparkContext.broadcast(trees)
    points = stored(points.mapInArrow(_placed(cells), f"v {kind}, ids array<bigint>, dim int, cell bigint, path array<double>"), "shards")
    ranges = points.select("dim", "cell", F.posexplode("path").alias("level", "d")).groupBy("dim", "cell", "level").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    for r in ranges.collect():  # at most MAX_CELLS times their depth of twelve
        trees[r["dim"]].low[r["cell"], r["level"]], trees[r["dim"]].high[r["cell"], r["level"]] = r["low"], r["high"]
    cells.unpersist()
    cells = spark.sparkContext.broadcast(trees)
    sizes = points.groupBy("dim", "cell").count()
    parts = F.broadcast(sizes.select(F.col("dim").alias("__dim"), F.col("cell").alias("__cell"), F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")))
    shards = sizes.agg(F.sum(F.ceil(F.col("count") / shard_rows))).first()[0] or 0
    tasks = max(shuffle_partitions(spark), -(-shards // 4))
    in_parts = lambda df: df.join(parts, (F.col("dim") == F.col("__dim")) & (F.col("cell") == F.col("__cell")))
    none = lambda t: F.lit(None).cast(t)
    held = in_parts(points).select("dim", "cell", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("sub"), none("bigint").alias("qid"), none("bigint").alias("id"), "v", "ids")

    def search(asked: DataFrame) -> DataFrame:
        sent = in_parts(asked.mapInArrow(_routed(cells, relax), f"qid bigint, id bigint, v {kind}, dim int, cell bigint"))
        sent = sent.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), "qid", "id", "v", none("array<bigint>").alias("ids"))
        dealt = held.unionByName(sent).repartition(tasks, "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", F.col("qid").asc_nulls_first())
        return stored(dealt.mapInArrow(_searched(k, relax), "qid bigint, id bigint, vec_id bigint, score double"), "found")

    asked = stored(rows.filter(F.col("id") % query_every == 0).withColumn("qid", F.monotonically_increasing_id()).select("qid", "id", "v"), "asked")
    home = search(asked.withColumn("far", none("double")))
    kth = home.groupBy("qid").agg(F.sort_array(F.collect_list("score")).alias("s")).select("qid", F.get("s", F.lit(k - 1)).alias("kth"))
    found = home.unionByName(search(asked.join(kth, "qid", "left").select("qid", "id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("far"))))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
