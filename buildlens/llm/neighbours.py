"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of a rotation that is learned on a bounded sample (iterative
quantisation: alternate between the signs and the rotation that fits them best).
A vector longer than others is first given one more component, so that the
largest inner product becomes the smallest angle. A code is split into
substrings, each with an index of its own. If two codes differ in at most ``R``
bits, they differ in at most ``R // m`` bits in one of ``m`` substrings, so
probing every substring's index that far finds every code within ``R``; those
are reranked by the true inner product.

``R`` is the least radius that finds 98 % of the sample's own neighbours. The
neighbours in the whole table are nearer than in the sample, so their recall is
higher. A block in which a query finds fewer codes than wanted within ``R`` is
searched entirely for it.

The table is dealt into blocks of bounded size, the stated queries too, and a
task searches one block of the table for one block of queries; it returns at
most ``k`` rows a query.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most. Rows that
repeat an id count once (the least vector). Ids that are null take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BITS, PARTS = 64, 8
#: Rows that the rotation and the radius are fitted on, and how many of them search.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
TABLE_BLOCK, QUERY_BLOCK = 16_384, 1_024
_BITS_OF = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    """The learned coding: projections, one a bit, and the norm that all are lengthened to."""

    planes: np.ndarray
    norm: float

    def of(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of ``PARTS`` bytes."""
        if query:
            more = np.zeros(len(vectors))
        else:
            more = np.sqrt(np.maximum(0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        return np.packbits(np.column_stack([vectors, more]) @ self.planes > 0, axis=1)


def learn(sample: np.ndarray, norm: float, seed: int = 7, rounds: int = 30) -> Codes:
    """Iterative quantisation on unit vectors; more rotations if there are fewer dimensions than bits."""
    more = np.sqrt(np.maximum(0, norm ** 2 - (sample ** 2).sum(axis=1)))
    data = np.column_stack([sample, more])
    data = data / np.linalg.norm(data, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(data.T @ data)
    axes = axes[:, ::-1][:, :BITS]
    data = data @ axes
    random, planes = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in planes) < BITS:
        turn = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(data @ turn > 0, 1.0, -1.0).T @ data)
            turn = (left @ right).T
        planes.append(axes @ turn)
    return Codes(np.column_stack(planes)[:, :BITS], norm)


def _distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _BITS_OF[codes ^ code].sum(axis=1)


def learn_radius(codes: Codes, sample: np.ndarray, k: int, share: float) -> int:
    """The least radius within which ``share`` of the sample's true neighbours lie."""
    queries = sample[:SAMPLE_QUERIES]
    near = sample @ queries.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    wanted = min(k, len(sample) - 1)
    if wanted < 1:
        return BITS
    best = np.argpartition(-near, wanted - 1, axis=0)[:wanted].T
    table, asked = codes.of(sample, query=False), codes.of(queries, query=True)
    distances = np.concatenate([_distance(table[b], a) for b, a in zip(best, asked, strict=True)])
    return int(np.quantile(distances, share, method="higher"))


class MultiIndex:
    """One block of the table: a bucket index for every substring of the codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.table = codes.of(vectors, query=False)
        self.order = [np.argsort(self.table[:, p], kind="stable") for p in range(PARTS)]
        self.ends = [np.concatenate(([0], np.cumsum(np.bincount(self.table[:, p], minlength=256))))
                     for p in range(PARTS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` bits: pigeonhole probing, then the distance."""
        reach, rest = divmod(radius, PARTS)
        found = np.zeros(len(self.ids), dtype=bool)
        for part in range(PARTS):
            # the first rest + 1 substrings are probed one bit further than the others
            most = reach if part <= rest else reach - 1
            order, ends = self.order[part], self.ends[part]
            for value in np.flatnonzero(_BITS_OF[np.arange(256) ^ code[part]] <= most):
                found[order[ends[value]:ends[value + 1]]] = True
        at = np.flatnonzero(found)
        return at[_distance(self.table[at], code) <= radius]

    def search(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int, radius: int):
        """(ids, scores) of the ``k`` nearest found, the query's own id left out."""
        at = self.within(code, radius)
        at = at[self.ids[at] != query_id]
        if len(at) < k:
            at = np.flatnonzero(self.ids != query_id)
        rough = self.vectors[at] @ query
        if len(at) > k:
            least = np.partition(rough, len(at) - k)[len(at) - k]
            at = at[rough >= least - 1e-9 * max(1.0, abs(least))]
        # summed in one order for every row, so that equal vectors get equal scores
        scores = (self.vectors[at] * query).sum(axis=1)
        first = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[first]], scores[first]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", share: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query row, from rank 1."""
    spark = vectors.sparkSession
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), wide.alias("v"),
                            is_query.alias("q")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    once = usable.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    once = once.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = checkpointed(once)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("q").cast("long")).alias("asked"),
        F.max("n").alias("norm"))
    most = lengths.orderBy(F.desc("rows"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not most:
        return spark.createDataFrame([], schema)
    size, count, asked, norm = most[0]["d"], most[0]["rows"], most[0]["asked"], most[0]["norm"]
    rows = rows.filter(F.size("v") == size)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] for r in sample])
    codes = learn(sample, norm)
    radius = learn_radius(codes, sample, k, share)
    tables, asks = math.ceil(count / TABLE_BLOCK), math.ceil(max(1, asked) / QUERY_BLOCK)

    def block(seed: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    table = rows.select("id", "v", block(1, tables).alias("t"), every(asks).alias("a"))
    queries = rows.filter("q").select("id", "v", block(2, asks).alias("a"), every(tables).alias("t"))

    def search(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = MultiIndex(mine["id"].to_numpy(), np.stack(mine["v"].to_numpy()), codes)
        wanted = np.stack(asking["v"].to_numpy())
        found = [
            (query_id, *index.search(query_id, query, code, k, radius))
            for query_id, query, code in
            zip(asking["id"].to_numpy(), wanted, codes.of(wanted, query=True), strict=True)
        ]
        return pd.DataFrame({
            "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
            "vec_id": np.concatenate([f[1] for f in found]),
            "score": np.concatenate([f[2] for f in found])})

    found = table.groupBy("t", "a").cogroup(queries.groupBy("t", "a")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
