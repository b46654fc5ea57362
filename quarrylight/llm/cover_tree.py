"""Exact top-k search by inner product: dual-tree search over cover trees.

Rows are dealt into blocks by their nearest pivot, so that blocks are compact; a pivot
with many rows has several blocks, so that none is large.  Queries form groups in the
same way.  Before anything is
shuffled, each query gives up every pivot whose ball, the covering radius of its rows or
their greatest length, leaves no score at its worst kth score; only groups and blocks
that a query is left for meet.  In each meeting a cover tree of the queries and one of
the rows are descended together.  A pair of nodes is given up if the largest score that their
covering radii leave possible is below the worst kth score of the node's queries.
Those scores start from a search of a fixed, bounded sample, so most of a far block
goes at its root.  The best of a query over all blocks are merged at the end.

Of rows with equal vectors only the ``k + 1`` with the smallest ids can be in any
answer (one may be the query itself); the others are left out before the search.

Scores are sums of integers, exact in doubles up to 2**53; larger ones are computed
with Python integers; those beyond the range of a long count as its nearest end.

Defined results: vectors that are null, empty, of another length than most of the
sample, or that hold a null or a non-finite component take no part; with fewer than
k candidates all are returned; ties go to the smaller id; rows equal in id and
vector count once; a null id takes no part; other columns are dropped; an empty
table has an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import ship_package, small, written

#: Rows in a block and queries in a group, about; pivots; rows of the first sample.
BLOCK, GROUP, PIVOTS, SAMPLE = 4096, 4096, 32, 2048
#: Points that a leaf of a tree holds at most, children that a node has at most, and
#: how much a level shrinks radii if so many children can.
LEAF, FANOUT, SHRINK = 64, 16, 0.6
LEAST_LONG = -(2**63)


@dataclass
class Node:
    """Points within ``radius`` of ``centre``."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    #: of a query node: the worst kth score below it
    worst: float = -math.inf

    @property
    def length(self) -> float:
        return float(np.sqrt(self.centre @ self.centre))


def cover_tree(vectors: np.ndarray, rows: np.ndarray | None = None, first: int | None = None) -> Node:
    """Children's centres are points of the node, found by going to the farthest point
    again and again: all points lie within the scale at which that ends of a centre,
    and the centres lie farther than that from one another.  It ends when the scale has
    shrunk enough, or at :data:`FANOUT` centres."""
    rows = np.arange(len(vectors)) if rows is None else rows
    first = int(rows[0]) if first is None else first
    own = vectors[rows]
    away = np.sqrt(((own - vectors[first]) ** 2).sum(axis=1))
    node = Node(vectors[first], float(away.max(initial=0.0)), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centres, nearest = [first], np.zeros(len(rows), np.int64)
    while len(centres) < FANOUT and away.max() > node.radius * SHRINK:
        centre = int(rows[away.argmax()])
        gap = np.sqrt(((own - vectors[centre]) ** 2).sum(axis=1))
        closer = gap < away
        nearest[closer], away[closer] = len(centres), gap[closer]
        centres.append(centre)
    node.children = [cover_tree(vectors, rows[nearest == k], centre) for k, centre in enumerate(centres)]
    return node


class DualTree:
    """One meeting of a query group and a block."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, start: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
        size = max(float(np.abs(queries).max(initial=0)), 1) * max(float(np.abs(rows).max(initial=0)), 1) * max(queries.shape[1], 1)
        self.exact = size >= 2.0**52
        self.q, self.r, self.qi, self.ri, self.k = queries, rows, query_ids, row_ids, k
        self.q_float, self.r_float = queries.astype(np.float64), rows.astype(np.float64)
        self.kth = start.astype(np.float64)
        self.best: list[list[tuple]] = [[] for _ in query_ids]  # (-score, id)
        self.visited = 0

    def run(self) -> list[list[tuple]]:
        if len(self.q) and len(self.r):
            top, rows = cover_tree(self.q_float), cover_tree(self.r_float)
            self._settle(top)
            self._descend(top, rows)
        return self.best

    def _settle(self, node: Node) -> None:
        for child in node.children:
            self._settle(child)
        node.worst = float(self.kth[node.points].min())

    def _bound(self, a: Node, b: Node) -> float:
        most = float(a.centre @ b.centre) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
        return most + 1e-9 * (a.length + a.radius) * (b.length + b.radius)

    def _descend(self, a: Node, b: Node) -> None:
        if self._bound(a, b) < a.worst:
            return
        if not a.children and not b.children:
            self._compare(a, b)
            return
        if b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -self._bound(a, c)):
                self._descend(a, child)
        else:
            for child in a.children:
                self._descend(child, b)
            a.worst = min(c.worst for c in a.children)

    def _compare(self, a: Node, b: Node) -> None:
        self.visited += len(a.points) * len(b.points)
        scores = self.q_float[a.points] @ self.r_float[b.points].T
        ids = self.ri[b.points]
        hopeful = (scores >= self.kth[a.points][:, None]).any(axis=1) | self.exact
        for n, i in ((n, int(a.points[n])) for n in np.flatnonzero(hopeful)):
            fit = np.flatnonzero((scores[n] >= self.kth[i] - abs(self.kth[i]) * 1e-9) & (ids != self.qi[i])) if self.exact and np.isfinite(self.kth[i]) else np.flatnonzero((scores[n] >= self.kth[i]) & (ids != self.qi[i]))
            if not len(fit):
                continue
            if self.exact:
                exact = lambda j: sum(x * y for x, y in zip(self.q[i].tolist(), self.r[j].tolist(), strict=True))  # noqa: B023, E731
                new = [(-exact(j), int(self.ri[j])) for j in b.points[fit].tolist()]
            else:
                new = [(-int(x), int(j)) for x, j in zip(scores[n][fit].tolist(), ids[fit].tolist(), strict=True)]
            self.best[i] = sorted(self.best[i] + new)[: self.k]
            if len(self.best[i]) == self.k:
                self.kth[i] = max(self.kth[i], float(-self.best[i][-1][0]))
        a.worst = float(self.kth[a.points].min())


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) as longs; null unless every component is finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when((F.size(vector) > 0) & finite, whole)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """``rows`` and ``queries`` hold an id and an array of longs, of one length.
    -> ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; a query is no candidate
    of its own."""
    spark = rows.sparkSession
    ship_package(spark)
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    # Spark limits a frequent vector's ranks in each task before it shuffles them
    order = Window.partitionBy("v").orderBy("id")
    kept = take(rows).distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    kept = written(kept.select("id", "v"), "topk-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # at most SAMPLE rows and PIVOTS of them as pivots, whatever the table's size
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return empty
    lengths = [len(r.v) for r in sample]
    width = max(set(lengths), key=lengths.count)
    sample = [r for r in sample if len(r.v) == width]
    ids, points = np.array([r.id for r in sample]), np.array([r.v for r in sample], np.int64)
    pivots = points[_spread(points, PIVOTS)].astype(np.float64)
    shared = spark.sparkContext.broadcast((ids, points, pivots))

    def placed(batches, balls: tuple[np.ndarray, np.ndarray] | None = None):
        """Rows with the nearest pivot, the distance to it and their length; queries, if
        the pivots' balls are known, with a first kth score and the pivots to visit."""
        near_ids, near, centres = shared.value
        for batch in batches:
            batch = batch[batch["v"].map(len) == width]
            if len(batch):
                vectors, own = _matrix(batch["v"]), batch["id"].to_numpy()
                pivot = ((centres**2).sum(axis=1) - 2 * vectors.astype(np.float64) @ centres.T).argmin(axis=1)
                out = pd.DataFrame({"id": own, "v": batch["v"].to_numpy(), "pivot": pivot})
                if balls is None:
                    exact = vectors.astype(np.float64)
                    yield out.assign(away=np.sqrt(((exact - centres[pivot]) ** 2).sum(axis=1)), length=np.sqrt((exact**2).sum(axis=1)))
                else:
                    start = _first_scores(vectors, own, near, near_ids, k)
                    hopeful = ~(_most(vectors.astype(np.float64), centres, *balls) < start[:, None])
                    yield out.assign(start=start, visits=[np.flatnonzero(h).tolist() for h in hopeful])

    def parts_of(counts: dict[int, int], size: int) -> tuple[list[int], list[int]]:
        """The number of each pivot's first part, and how many parts of about that size
        it has; small pivots share one, near rows stay together."""
        first, parts, number, room = [0] * len(pivots), [1] * len(pivots), -1, 0
        for pivot, n in sorted(counts.items()):
            if n > room:
                number, room = number + 1, size
            first[pivot], parts[pivot] = number, max(1, -(-n // size))
            number += parts[pivot] - 1
            room = room - n if parts[pivot] == 1 else 0
        return first, parts

    def at(values: list[int], pivot: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (pivot + 1).cast("int"))

    def dealt(first: list[int], parts: list[int]) -> Column:
        return at(first, F.col("pivot")) + F.pmod(F.xxhash64("id"), at(parts, F.col("pivot"))).cast("int")

    blocks = written(kept.mapInPandas(lambda it: placed(it), "id long, v array<long>, pivot long, away double, length double"), "topk-blocks")
    found = blocks.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("length").alias("length")).collect()  # a row a pivot
    radii, lengths = np.full(len(pivots), -np.inf), np.full(len(pivots), -np.inf)
    for r in found:
        radii[r.pivot], lengths[r.pivot] = r.away, r.length
    groups = written(take(queries).distinct().mapInPandas(lambda it: placed(it, (radii, lengths)), "id long, v array<long>, pivot long, start double, visits array<int>"), "topk-groups")
    sizes = {r.pivot: r.n for r in groups.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    if not sizes:
        return empty
    first, parts = parts_of({r.pivot: r.n for r in found}, BLOCK)
    last = [a + n - 1 for a, n in zip(first, parts, strict=True)]
    visited = F.array_distinct(F.flatten(F.transform("visits", lambda p: F.sequence(at(first, p), at(last, p)))))
    groups = groups.select(dealt(*parts_of(sizes, GROUP)).alias("g"), F.explode(visited).alias("b"), "id", "v", "start")
    meetings = written(groups.select("g", "b").distinct(), "topk-meetings")
    blocks = blocks.select(dealt(first, parts).alias("b"), "id", "v").join(small(meetings), "b")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        search = DualTree(_matrix(left["v"]), left["id"].to_numpy(), left["start"].to_numpy(), _matrix(right["v"]), right["id"].to_numpy(), k)
        found = [(q, i, max(LEAST_LONG, min(-s, -LEAST_LONG - 1))) for q, best in zip(left["id"].tolist(), search.run(), strict=True) for s, i in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = groups.groupBy("g", "b").cogroup(blocks.groupBy("g", "b")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _most(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The highest score that each query can have with a row of each pivot's ball, with
    room for rounding; -inf for a pivot without rows."""
    own = np.sqrt((queries**2).sum(axis=1))[:, None]
    held, away, longest = np.isfinite(radii) & np.isfinite(lengths), np.where(radii >= 0, radii, 0), np.where(lengths >= 0, lengths, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        ball = queries @ centres.T + own * away
        slack = 1e-9 * own * (np.sqrt((centres**2).sum(axis=1)) + away + longest) + 1e-6
        most = np.minimum(ball, own * longest) + slack
    return np.where(held, most, np.where(np.isneginf(radii), -np.inf, np.inf))


def _spread(points: np.ndarray, n: int) -> list[int]:
    """Indices of points that are far from one another."""
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        gap = np.minimum(gap, ((points - points[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return chosen


def _first_scores(queries: np.ndarray, query_ids: np.ndarray, near: np.ndarray, near_ids: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's kth score: its kth score in the sample, less what
    doubles may have rounded."""
    scores = queries.astype(np.float64) @ near.astype(np.float64).T
    scores[query_ids[:, None] == near_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(queries), -np.inf)
    kth = np.partition(scores, -k, axis=1)[:, -k]
    return kth - np.abs(kth) * 1e-9 if np.abs(kth[np.isfinite(kth)]).max(initial=0) >= 2.0**52 else kth
