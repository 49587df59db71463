"""How quality filters interact in every order, by difference arrays over Lehmer ranks.

Documents are counted by the set of filters that they fail, their mask. For an
order of the filters, a mask's documents go at the first filter that is in the
mask. The orders in which that is step ``s``, at filter ``f``, are those that start
with ``s - 1`` filters outside the mask and then ``f``: for each such start an
interval of lexicographic (Lehmer) ranks. The mask's count is added where each
interval begins and taken off where it ends, in one array for each step; the
running sum over the 120 ranks is then what each order removes at that step. So
no order is tried on any document, and a part of the corpus costs its 32 masks.

Texts are read once, in Python, row by row; all else is grouped counts. Whether a
text repeats that of a smaller id is asked of the whole table, before any filter:
the smallest id of each text is a combined minimum over digests, and a document is
a repeat unless it is found among those, a join on digest and id that no large
group of copies makes uneven.

Defined cases: null text is empty text, null language the empty string. A
document without an id is no repeat, makes none, and has no labels. Documents that
share id and text are no repeats of each other. A document is good, or toxic, if any
label row of its id says so. A part without removals still has all its rows; an
empty table has none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .rows import map_rows

#: The filters by letter; the last one asks about the whole table.
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counted for every mask: documents, good ones and toxic ones.
COUNTED = ("n", "good", "toxic")


def failed(text: str | None) -> int:
    """The filters A to D that a text fails, as bits."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes: ASCII white space only
    conditions = (len(words) < 200,
                  100 * len(set(words)) < 50 * len(words),
                  100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text),
                  len(raw) > len(raw.translate(None, SIGNS)))
    return sum(1 << i for i, fails in enumerate(conditions) if fails)


def orders(letters: str = FILTERS) -> list[str]:
    """All orders of the filters, by rank."""
    return ["".join(p) for p in itertools.permutations(letters)]


def lehmer_rank(start: tuple[int, ...], size: int) -> int:
    """The rank of the first order that begins with ``start``."""
    left, rank = list(range(size)), 0
    for i, item in enumerate(start):
        rank += left.index(item) * math.factorial(size - 1 - i)
        left.remove(item)
    return rank


def removal_differences(size: int) -> np.ndarray:
    """[mask, step, rank]: the ends of the rank intervals where the mask goes at the step."""
    ranks = math.factorial(size)
    ends = np.zeros((1 << size, size, ranks + 1), np.int64)
    for mask in range(1, 1 << size):
        outside = [i for i in range(size) if not mask >> i & 1]
        inside = [i for i in range(size) if mask >> i & 1]
        for step in range(len(outside) + 1):
            length = math.factorial(size - 1 - step)
            for before in itertools.permutations(outside, step):
                for at in inside:
                    rank = lehmer_rank((*before, at), size)
                    ends[mask, step, rank] += 1
                    ends[mask, step, rank + length] -= 1
    return ends


class Totals:
    """Turns counts by mask into the rows of all orders and steps."""

    def __init__(self, letters: str = FILTERS):
        size = len(letters)
        self.ends = removal_differences(size)
        self.orders = orders(letters)
        #: [rank, step]: the filter that runs there
        self.filter = np.array([[letters.index(c) for c in o] for o in self.orders])
        masks = np.arange(1 << size)
        self.fails = (masks[:, None] >> np.arange(size) & 1).astype(np.int64)

    def of(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """[rank, step] totals of one part from its counts, [mask, counted]."""
        # counts at interval ends, then running sums: [counted, step, rank]
        removed = np.tensordot(counts.T, self.ends, axes=1).cumsum(axis=2)[:, :, :-1]
        removed, good, toxic = removed.transpose(0, 2, 1)
        failing = (counts[:, 0] @ self.fails)[self.filter]
        alone = counts[1 << np.arange(self.fails.shape[1]), 0][self.filter]
        of_filter = np.zeros(self.fails.shape[1], np.int64)
        np.add.at(of_filter, self.filter, removed)
        return {"kept": counts[:, 0].sum() - removed.cumsum(axis=1), "removed": removed,
                "redundant": failing - removed, "unique_fails": alone, "good_lost": good,
                "toxic_lost": toxic, "shapley": of_filter[self.filter]}


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail."""

    def work():
        def do(rows: list[tuple]) -> list[tuple]:
            return [(failed(text), hashlib.sha256((text or "").encode("utf-8")).digest())
                    for (text,) in rows]

        return do

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.col(text_col).alias("text"))
    read = map_rows(slim, ["text"], "mask int, digest binary", work, keep=["id", "part"])
    # Rows that agree in everything are one row with a count, combined before the
    # shuffle. All that follows reads these narrow rows, so the texts are read once.
    units = checkpointed(read.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    firsts = units.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeat = F.col("id").isNotNull() & F.col("first").isNull()
    judged = units.join(firsts, ["digest", "id"], "left").select(
        "id", "part", "n", (F.col("mask") + F.when(repeat, 1 << len(FILTERS) - 1).otherwise(0)).alias("mask"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id would all meet in one task of the join
    labelled = judged.filter("id IS NOT NULL").join(known, "id", "left").select("part", "mask", "n", "good", "toxic")
    nameless = judged.filter("id IS NULL").select(
        "part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))

    def lost(label: str):
        return F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias(label)

    return labelled.union(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), lost("good"), lost("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text."""
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    # a part is one row of at most 32 masks
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("masks"))
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        ranks, steps = totals.filter.shape
        order = pa.array(np.repeat(totals.orders, steps).tolist(), pa.string())
        step = pa.array(np.tile(np.arange(1, steps + 1), ranks), pa.int32())
        for batch in batches:
            for part, masks in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                table = np.zeros((1 << len(FILTERS), len(COUNTED)), np.int64)
                for row in masks:
                    table[row["mask"]] = [row[c] for c in COUNTED]
                found = totals.of(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(order), pa.string()), order, step,
                     *[pa.array(found[m].reshape(-1), pa.int64()) for m in measures]],
                    names=["part", "filter_order", "step", *measures])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(
        f"{m} long" for m in measures))
