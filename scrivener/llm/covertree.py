"""Exact top-k search by inner product with cover trees over queries and data.

A node of a tree has a centre, one of its points, and a covering radius, within which all
of its points lie. Its children's centres are a net of its points: picked by farthest
first, so that they are at least as far from one another as any point is from its own
centre. Where no net of a few points brings the radius down, as in data without clusters,
the points are halved instead, and each half has its own centre and radius. A pair of a query node and a data node is skipped when no inner product between
their points can reach the worst k-th score of the node's queries: with centres q and p
and radii r and s that is at most q.p + |q| s + |p| r + r s.

The net of a bounded sample gives the upper nodes, *cells*, and every point and every
query goes to the cell of its nearest centre. Queries first meet a tree over the sample,
which leaves each with a k-th score to beat. Query cells and data cells are then pruned as
pairs, and queries go only to the cells that remain, where a tree over the queries at hand
meets the cell's tree. Data is dealt out once, its trees are built once, and queries stream
past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import shuffle_partitions, stored
from scrivener.llm.vptree import _by_length

K = 5
QUERY_EVERY = 50
#: Vectors are scaled by this and rounded down.
SCALE = 256
#: Points of a cell's tree, at most, and at least where there are cores for more; a larger cell is divided by hash.
CELL_ROWS, LEAST_ROWS = 1 << 15, 1 << 10
#: Points that the cells' centres are picked from, and cells of one vector length.
SAMPLE, MAX_CELLS = 1 << 13, 1 << 12
#: Children of a node, points of one that has none, and queries of one.
CHILDREN, LEAF, GROUP = 32, 128, 32
#: A level that does not bring the radius below this share of its parent's is left out.
SHRINK = 0.75
#: Slack for rounding in bounds, relative to the terms they are made of.
SLACK = 1e-9
#: Largest whole number up to which sums in double precision are exact, and the ends at which larger ones are held.
EXACT, LONG = 1 << 53, (1 - (1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite; zero vectors count."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision, as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def farthest_first(points: np.ndarray, centres: int, enough: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows of a net, each point's place in it and distance to its centre.

    Begins with the point nearest to the mean; stops at ``centres`` rows or when all points lie within ``enough``.
    """
    first = int(np.argmin(_away(points, points.mean(axis=0))))
    picked, owner = [first], np.zeros(len(points), np.int64)
    off = _away(points, points[first])
    while len(picked) < centres:
        row = int(np.argmax(off))
        if off[row] <= enough:
            break
        new = _away(points, points[row])
        nearer = new < off
        owner[nearer], off[nearer] = len(picked), new[nearer]
        picked.append(row)
    return picked, owner, off


def _away(points: np.ndarray, from_: np.ndarray) -> np.ndarray:
    d = points - from_
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """A tree over the rows of ``points``; ``order`` lists them so that a node's are next to one another."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.zeros(len(points), np.int64)
        self.low: list[int] = []
        self.high: list[int] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.filled = 0
        if len(points):
            self._build(np.arange(len(points)))
        self.low, self.high, self.centre = (np.array(x, np.int64) for x in (self.low, self.high, self.centre))
        self.radius = np.array(self.radius, np.float64)
        self.middles = points[self.centre]
        self.lengths = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.norms = self.lengths[self.centre]

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.low)
        self.low.append(self.filled)
        here = self.points[rows]
        first = int(np.argmin(_away(here, here.mean(axis=0))))
        reach = float(_away(here, here[first]).max())
        self.centre.append(int(rows[first]))
        self.radius.append(reach)
        self.children.append(np.zeros(0, np.int64))
        self.high.append(0)
        parts = []
        if len(rows) > self.leaf and reach > 0:
            picked, owner, off = farthest_first(here, CHILDREN, reach / 2)
            if off.max() <= SHRINK * reach:
                parts = [rows[owner == n] for n in range(len(picked))]
            else:
                # no net of few points tells these apart: their own halves by order along the two farthest keep nodes small
                parts = _halves(rows, here, picked)
        if len(parts) > 1:
            self.children[at] = np.array([self._build(p) for p in parts], np.int64)
        else:
            self.order[self.filled : self.filled + len(rows)] = rows
            self.filled += len(rows)
        self.high[at] = self.filled
        return at


def _halves(rows: np.ndarray, here: np.ndarray, picked: list[int]) -> list[np.ndarray]:
    """The points in parts of equal size, by how much nearer they are to one of two distant points than to the other."""
    lean = _away(here, here[picked[1]]) - _away(here, here[picked[2]])
    by = np.argsort(lean, kind="stable")
    return [np.sort(rows[p]) for p in np.array_split(by, 2)]


class Best:
    """The k highest (score, smaller identifier first) of each query, and the score that another must reach."""

    def __init__(self, own: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = own, k, floor
        self.scores = np.full((len(own), k), LONG[0])
        self.ids = np.full((len(own), k), LONG[1])
        self.filled = np.zeros((len(own), k), bool)

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.floor[queries][:, None]) & (ids[None, :] != self.own[queries][:, None])
        some, of = good.any(axis=1), good.any(axis=0)
        if not some.any():
            return
        queries, ids, scores, good = queries[some], ids[of], scores[np.ix_(some, of)], good[np.ix_(some, of)]
        filled = np.concatenate((self.filled[queries], good), axis=1)
        ids = np.concatenate((self.ids[queries], np.broadcast_to(ids, good.shape)), axis=1)
        scores = np.concatenate((self.scores[queries], scores), axis=1)
        by = np.lexsort((ids, -scores, ~filled), axis=1)[:, : self.k]
        self.filled[queries], self.ids[queries], self.scores[queries] = (np.take_along_axis(x, by, axis=1) for x in (filled, ids, scores))
        full = queries[self.filled[queries, -1]]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, identifiers and scores."""
        return np.nonzero(self.filled)[0], self.ids[self.filled], self.scores[self.filled]


class Searched:
    """One data tree, met by query trees."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.tree = CoverTree(vectors.astype(np.float64))
        self.largest = int(np.abs(vectors).max(initial=0))
        self.pairs = 0

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond a long, its ends."""
        asked, held = queries, self.vectors[rows]
        if self.largest * int(np.abs(asked).max(initial=0)) * max(1, asked.shape[1]) <= EXACT:
            return (asked.astype(np.float64) @ held.astype(np.float64).T).astype(np.int64)
        whole = asked.astype(object) @ held.astype(object).T
        return np.clip(whole, *LONG).astype(np.int64)

    def search(self, queries: np.ndarray, best: Best) -> None:
        asked = CoverTree(queries.astype(np.float64), GROUP)
        if not len(queries) or not len(self.ids):
            return
        stack = [(0, np.array([0]))]
        while stack:
            group, nodes = stack.pop()
            rows = asked.order[asked.low[group] : asked.high[group]]
            reach = self._bound(asked, group, nodes)
            nodes = nodes[np.argsort(reach, kind="stable")]
            reach = np.sort(reach, kind="stable")
            nodes = nodes[reach >= best.floor[rows].min()]
            if not len(nodes):
                continue
            inner = [n for n in nodes.tolist() if len(self.tree.children[n])]
            leaves = np.array([n for n in nodes.tolist() if not len(self.tree.children[n])], np.int64)
            groups = asked.children[group] if len(asked.children[group]) else [group]
            if inner:
                below = np.concatenate([leaves, *[self.tree.children[n] for n in inner]])
                stack += [(int(g), below) for g in groups]
            elif len(asked.children[group]):
                stack += [(int(g), leaves) for g in groups]
            else:
                single = upper_bound(asked.points[rows], asked.lengths[rows][:, None], 0.0, self.tree.middles[leaves], self.tree.norms[leaves], self.tree.radius[leaves])
                for n, bound in zip(leaves[::-1].tolist(), single.T[::-1], strict=True):
                    # the score to beat rises as leaves are met, the likeliest first
                    still = rows[bound >= best.floor[rows]]
                    if len(still):
                        held = self.tree.order[self.tree.low[n] : self.tree.high[n]]
                        self.pairs += len(still) * len(held)
                        best.offer(still, self.ids[held], self.scores(queries[still], held))

    def _bound(self, asked: CoverTree, group: int, nodes: np.ndarray) -> np.ndarray:
        return upper_bound(asked.middles[group], asked.norms[group], asked.radius[group], self.tree.middles[nodes], self.tree.norms[nodes], self.tree.radius[nodes])


def upper_bound(q: np.ndarray, q_norm, r, p: np.ndarray, p_norm: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The highest inner product of points within r of q, or of each row of q, and within s of each row of p."""
    room = q_norm * s + p_norm * r + r * s
    return q @ p.T + room + SLACK * (room + q_norm * p_norm) + 1e-6


class Cells:
    """Centres of the upper nodes, and the reach of their queries and points."""

    def __init__(self, sample: np.ndarray, cells: int):
        picked, _, _ = farthest_first(sample.astype(np.float64), cells)
        self.centres = sample[picked].astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.points = np.full(len(picked), -1.0)
        self.queries: dict[int, tuple[float, int]] = {}

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of every point, and the distance to it."""
        cell, off = np.zeros(len(points), np.int64), np.zeros(len(points))
        step = max(1, (1 << 22) // max(1, len(self.centres)))
        for i in range(0, len(points), step):
            part = points[i : i + step].astype(np.float64)
            near = np.argmin(self.norms**2 - 2 * (part @ self.centres.T), axis=1)
            cell[i : i + step] = near
            d = part - self.centres[near]
            off[i : i + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return cell, off

    def open_to(self, cell: int) -> list[int]:
        """Data cells where some query of a cell may find a score as high as the lowest that its queries have to beat."""
        radius, floor = self.queries[cell]
        bound = upper_bound(self.centres[cell], self.norms[cell], radius, self.centres, self.norms, np.maximum(self.points, 0.0))
        return np.flatnonzero((self.points >= 0) & (bound >= floor)).tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, which may be 0, as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.maximum(flat, LONG[0]).reshape(len(column), len(flat) // max(1, len(column)))


def _placed(cells):
    """Rows (id, v) with dim, cell and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 1) if whole.num_rows else ():
                points = _matrix(batch.column(1))
                cell, off = cells.value[points.shape[1]].assign(points)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([points.shape[1]] * len(points), pa.int32()), pa.array(cell), pa.array(off)], ["id", "v", "dim", "cell", "off"])

    return run


def _floored(cells, sample, k: int):
    """Queries (qid, id, v) with dim, cell, the distance to its centre and the k-th highest score in the sample."""
    trees: dict[int, Searched] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 2) if whole.num_rows else ():
                asked = _matrix(batch.column(2))
                dim = asked.shape[1]
                if dim not in trees:
                    trees[dim] = Searched(*sample.value[dim])
                cell, off = cells.value[dim].assign(asked)
                best = Best(batch.column(1).to_numpy(), k, np.full(len(asked), LONG[0]))
                trees[dim].search(asked, best)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([dim] * len(asked), pa.int32()), pa.array(cell), pa.array(off), pa.array(best.floor)], ["qid", "id", "v", "dim", "cell", "off", "floor"])

    return run


def _routed(cells):
    """Queries (qid, id, v, floor, dim, cell) to every data cell that their own cell's pair leaves open."""
    known: dict[tuple[int, int], list[int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to: list[list[int]] = []
            for key in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if key not in known:
                    known[key] = cells.value[key[0]].open_to(key[1])
                to.append(known[key])
            rows = np.repeat(np.arange(len(to)), list(map(len, to)))
            target = np.array([c for cs in to for c in cs], np.int64)
            for i in range(0, len(rows), 1 << 12):
                part = batch.take(pa.array(rows[i : i + (1 << 12)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(target[i : i + (1 << 12)])], ["qid", "id", "v", "floor", "dim", "cell"])

    return run


def _met(k: int):
    """Rows (dim, cell, part, qid, id, v, floor), sorted so that a cell's points (qid null) come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, held = None, [], [], None
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
                    at, vectors, ids, held = tuple(keys[i]), [], [], None
                if not query[i]:
                    vectors.append(_matrix(part.column(5)))
                    ids.append(part.column(4).to_numpy())
                    continue
                if not ids:
                    continue  # a part of a cell without points
                if held is None:
                    held, vectors = Searched(np.concatenate(vectors), np.concatenate(ids)), []
                best = Best(part.column(4).to_numpy(), k, part.column(6).to_numpy().copy())
                held.search(_matrix(part.column(5)), best)
                of, other, scores = best.rows()
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column(3).take(of), part.column(4).take(of), pa.array(other), pa.array(scores)], ["qid", "id", "vec_id", "score"])

    return run


def top_inner(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    query_every: int = QUERY_EVERY,
    cell_rows: int = CELL_ROWS,
    least_rows: int = LEAST_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """The k rows of highest inner product with each row whose identifier is divisible by ``query_every``.

    Components are scaled and rounded down first, so scores are whole numbers. Returns
    query_id, rank (from 1), vec_id and score (long), highest first, ties to the smaller
    identifier; all candidates if there are fewer than k. The search is exact: bounds on
    cells, the sample and leaves change no row.

    Defined cases: vectors that are null or hold null or non-finite components take no
    part, nor do null identifiers; zero and empty vectors do, with score 0; vectors are
    compared with those of their own length only; components and scores beyond a long are
    held at 2^63 - 1 or its negative; rows that repeat an identifier and its scaled vector are one; those
    that repeat an identifier alone are candidates once for each vector, and never for a
    query of that identifier; of equal vectors, no list of k needs more than the k + 1
    smallest identifiers, and no more are dealt out; other columns are not looked at; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = given.filter(usable(F.col("v")) & F.col("id").isNotNull()).select("id", scaled(F.col("v"), scale).alias("v")).distinct()
    rows = stored(rows, "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = rows.withColumn("n", place).filter(F.col("n") <= k + 1).select("id", "v")
    points = stored(points, "points")
    # one row a length of vectors
    lengths = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}
    some: dict[int, tuple[list, list]] = {}
    for r in points.orderBy(F.xxhash64("id", "v"), "id", "v").limit(sample).collect():
        held = some.setdefault(len(r["v"]), ([], []))
        held[0].append(r["v"])
        held[1].append(r["id"])
    held = {d: (np.array(vs, np.int64).reshape(len(vs), d), np.array(ids, np.int64)) for d, (vs, ids) in some.items()}
    for d in lengths:  # a length that the sample missed has one cell
        held.setdefault(d, (np.zeros((0, d), np.int64), np.zeros(0, np.int64)))
    cores = shuffle_partitions(spark)
    wanted = {d: min(MAX_CELLS, max(-(-n // cell_rows), min(cores, -(-n // least_rows)))) for d, n in lengths.items()}
    trees = {d: Cells(vs if len(vs) else np.zeros((1, d), np.int64), wanted[d]) for d, (vs, _) in held.items()}
    cells, drawn = spark.sparkContext.broadcast(trees), spark.sparkContext.broadcast(held)
    points = stored(points.mapInArrow(_placed(cells), "id bigint, v array<bigint>, dim int, cell bigint, off double"), "cells")
    asked = rows.filter(F.col("id") % query_every == 0).withColumn("qid", F.monotonically_increasing_id()).select("qid", "id", "v")
    asked = stored(asked.repartition(cores).mapInArrow(_floored(cells, drawn, k), "qid bigint, id bigint, v array<bigint>, dim int, cell bigint, off double, floor bigint"), "asked")
    # at most MAX_CELLS rows a length each
    sizes = points.groupBy("dim", "cell").agg(F.count("*").alias("count"), F.max("off").alias("off"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("count") / cell_rows).cast("int")), "sizes")
    for r in sizes.collect():
        trees[r["dim"]].points[r["cell"]] = r["off"] * (1 + SLACK)
    for r in asked.groupBy("dim", "cell").agg(F.max("off").alias("off"), F.min("floor").alias("floor")).collect():
        trees[r["dim"]].queries[r["cell"]] = (r["off"] * (1 + SLACK), r["floor"])
    cells.unpersist()
    cells = spark.sparkContext.broadcast(trees)
    parts = F.broadcast(sizes.select(F.col("dim").alias("__dim"), F.col("cell").alias("__cell"), "parts"))
    in_parts = lambda df: df.join(parts, (F.col("dim") == F.col("__dim")) & (F.col("cell") == F.col("__cell")))
    none = F.lit(None).cast("bigint")
    dealt = in_parts(points).select("dim", "cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), none.alias("qid"), "id", "v", none.alias("floor"))
    sent = in_parts(asked.select("qid", "id", "v", "floor", "dim", "cell").mapInArrow(_routed(cells), "qid bigint, id bigint, v array<bigint>, floor bigint, dim int, cell bigint"))
    sent = sent.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "id", "v", "floor")
    tasks = max(cores, sizes.agg(F.sum("parts")).first()[0] or 0)
    met = dealt.unionByName(sent).repartition(tasks, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", F.col("qid").asc_nulls_first())
    found = met.mapInArrow(_met(k), "qid bigint, id bigint, vec_id bigint, score bigint")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
