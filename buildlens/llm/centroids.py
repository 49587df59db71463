"""K-means over integer vectors with a vantage-point tree over the centroids.

Every round the driver builds a vantage-point tree over the centroids and
broadcasts it. A tree has one centroid a node; the others lie in its inner half,
no farther than the median distance, or in its outer half. Each vector searches
best first: it takes the waiting subtree with the least bound, computes the exact
distance to that node's centroid and lets both halves wait with their bounds by
the triangle inequality. It ends when the least bound exceeds the best distance;
a bound equal to it is still visited, as a centroid of a smaller number may wait
there. The searches of a group of vectors take their steps together, in numpy, but
every vector has its own queue and skips on its own.

Distances are exact squared integers and ties go to the smaller number. Bounds are
floats, lowered by more than their rounding error, so they never skip wrongly.

New centroids are exact floors of sums over counts. Tasks add up their own vectors;
sums are split into digits of 40 bits, so that adding them up in a shuffle is exact
for numbers of any size. What reaches the driver is a few digits for each centroid
and component, whatever the number of vectors.

Defined cases: vectors of another length, null, or with null or non-finite
components take no part. Rows are vectors: repeated ids count as often as they
occur, and are told apart by nothing as centroids. Rows without an id take part,
but are first centroids only if there are too few others. With fewer vectors than
centroids, each is one. An empty table gives no rows. A distance that does not fit
a long is null, and so is every sum of distances with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Components up to this size have squared distances below 2 ** 62.
SAFE = 1 << 27
DIGIT = 40
#: More than twice the relative rounding error of a root and a difference.
SLACK = 1e-14


class Node(NamedTuple):
    centroid: int
    #: no centroid of the inner half is farther, none of the outer half nearer
    inner_to: float
    outer_from: float
    inner: int
    outer: int


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, row by row, in the integers that the arrays hold."""
    apart = vectors - others
    return (apart * apart).sum(axis=-1)


def as_integers(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows as numpy integers, or as Python's where those might overflow."""
    found = np.array(rows, dtype=object).reshape(-1, width)
    small = all(-SAFE <= x <= SAFE for x in found.flat)
    return found.astype(np.int64) if small else found


def roots(squares: np.ndarray) -> np.ndarray:
    """Their roots, infinite where a root is no finite float."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(float))
    # by halves of the exponent: a square may be too large for a float
    def root(square: int) -> float:
        half = max(0, (square.bit_length() - 900) // 2)
        try:
            return float(np.sqrt(float(square >> 2 * half))) * 2.0 ** half
        except OverflowError:
            return float("inf")

    return np.array([root(int(s)) for s in squares.flat], float).reshape(squares.shape)


class VantageTree:
    """The tree over a list of centroids; its searches are exact."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[Node] = []
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        """The number of a new node for ``members``, -1 for none."""
        if not members:
            return -1
        at, (vantage, *others) = len(self.nodes), members
        self.nodes.append(Node(vantage, 0.0, 0.0, -1, -1))
        if others:
            far = roots(squared(self.centroids[others], self.centroids[vantage]))
            order = np.argsort(far, kind="stable")
            half = (len(others) + 1) // 2
            inner, outer = order[:half], order[half:]
            self.nodes[at] = Node(
                vantage, float(far[inner].max()), float(far[outer].min()) if len(outer) else 0.0,
                self._build([others[i] for i in inner]), self._build([others[i] for i in outer]))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each vector and how many distances were computed."""
        n, count = len(vectors), len(self.nodes)
        centroid = np.array([x.centroid for x in self.nodes])
        inner_to, outer_from = (np.array([getattr(x, k) for x in self.nodes]) for k in ("inner_to", "outer_from"))
        inner, outer = (np.array([getattr(x, k) for x in self.nodes]) for k in ("inner", "outer"))
        bounds = np.full((n, count), np.inf)  # of waiting subtrees
        bounds[:, 0] = 0.0
        best = np.full(n, -1)
        best_square = np.zeros(n, dtype=object if object in (vectors.dtype, self.centroids.dtype) else np.int64)
        reach = np.full(n, np.inf)  # no smaller than the best distance
        active, computed = np.arange(n), 0
        while len(active):
            node = bounds[active].argmin(axis=1)
            least = bounds[active, node]
            waits = (least <= reach[active]) & np.isfinite(least)
            active, node, least = active[waits], node[waits], least[waits]
            if not len(active):
                break
            bounds[active, node] = np.inf
            number = centroid[node]
            square = squared(vectors[active], self.centroids[number])
            computed += len(active)
            now, holder = best_square[active], best[active]
            wins = (holder < 0) | (square < now) | ((square == now) & (number < holder))
            won = active[wins]
            best[won], best_square[won] = number[wins], square[wins]
            distance = roots(square)
            reach[won] = distance[wins] * (1 + SLACK)
            for child, gap, edge in ((inner, distance - inner_to[node], inner_to[node]),
                                     (outer, outer_from[node] - distance, outer_from[node])):
                has = child[node] >= 0
                with np.errstate(invalid="ignore"):
                    gap = np.nan_to_num(gap - SLACK * (distance + edge), nan=0.0, posinf=0.0)
                # finite, or the subtree would not wait
                bounds[active[has], child[node][has]] = np.minimum(
                    np.maximum(least, gap), np.finfo(float).max)[has]
        return best, best_square, computed


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def integers(batch: pa.RecordBatch, column: int, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components; a power of two as scale makes the product exact."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = flat.reshape(-1, width)
    if len(flat) and np.abs(flat).max() * scale > SAFE:
        return np.array([[int(np.floor(x)) * scale if abs(x) >= 2**53 else int(np.floor(x * scale))
                          for x in row] for row in whole.tolist()], dtype=object)
    return np.floor(whole * scale).astype(np.int64)


def digits(total: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a number: the sum of digit * 2 ** (40 * place)."""
    sign, total, place = (-1, -total, 0) if total < 0 else (1, total, 0)
    while total:
        yield place, sign * (total & ((1 << DIGIT) - 1))
        total, place = total >> DIGIT, place + 1


def _assign(vectors: DataFrame, tree: VantageTree, width: int, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, square, _ = sent.value.nearest(integers(batch, 1, width, scale))
            fits = [int(s) if s < 2**63 else None for s in square]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()), pa.array(fits, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _sums(vectors: DataFrame, tree: VantageTree, width: int, scale: int) -> tuple[dict, dict]:
    """Exact (sums by cluster, counts by cluster) of the vectors that are nearest to each."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            rows = integers(batch, 0, width, scale)
            best, _, _ = sent.value.nearest(rows)
            for cluster in np.unique(best).tolist():
                mine = rows[best == cluster]
                # a batch's sum fits: components are below 2 ** 27 or Python's integers
                part = mine.sum(axis=0).astype(object)
                sums[cluster] = sums.get(cluster, 0) + part
                counts[cluster] = counts.get(cluster, 0) + len(mine)
        found = [(c, i, place, digit) for c, total in sums.items()
                 for i, component in enumerate(total.tolist()) for place, digit in digits(component)]
        # the count travels as one more component
        found += [(c, width, place, digit) for c, n in counts.items() for place, digit in digits(n)]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["cluster", "component", "place", "digit"])

    parts = vectors.select("vector").mapInArrow(
        run, "cluster int, component int, place int, digit long")
    sums: dict[int, list[int]] = {}
    for row in parts.groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit")).collect():
        total = sums.setdefault(row["cluster"], [0] * (width + 1))
        total[row["component"]] += row["digit"] << DIGIT * row["place"]
    return {c: t[:width] for c, t in sums.items()}, {c: t[width] for c, t in sums.items()}


def _first_centroids(vectors: DataFrame, count: int, seed: str, width: int, scale: int) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "vector").orderBy(
        F.col("mark").asc_nulls_last(), "vector").limit(count).select("vector").toArrow()
    batches = rows.combine_chunks().to_batches()
    return integers(batches[0], 0, width, scale) if batches else np.zeros((0, width), np.int64)


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 16,
            rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable row, the final centroids)."""
    vectors = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(
        usable(F.col("vector"), width))
    centroids = _first_centroids(vectors, count, seed, width, scale)
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        sums, counts = _sums(vectors, VantageTree(centroids), width, scale)
        centroids = as_integers([[x // counts[c] for x in sums[c]] if c in sums else old
                                 for c, old in enumerate(centroids.tolist())], width)
    return _assign(vectors, VantageTree(centroids), width, scale), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters_with_inertia(table: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row."""
    assigned, centroids = cluster(table, **options)
    spark = table.sparkSession
    # read twice: once for the sums, once for the rows
    assigned = checkpointed(assigned)

    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    total = F.when(F.count("distance") == F.count(F.lit(1)), exact)
    of_each = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(total.alias("n")).collect()}
    whole = None if None in of_each.values() else sum(map(int, of_each.values()))

    def fitting(value) -> int | None:
        return int(value) if value is not None and value < 2**63 else None

    known = [(c, fitting(n), fitting(whole), centroid_digest(centroids[c].tolist())) for c, n in of_each.items()]
    named = spark.createDataFrame(
        known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
