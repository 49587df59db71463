"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position gets a non-zero code of ``radius + 1`` bits. A table exists
for every non-zero vector of that many bits and keeps the positions whose code
has an odd product with it. The codes of at most ``radius`` differing positions
cannot span the whole space, so some vector is orthogonal to all of them: that
table keeps none of the differing positions, and the two fingerprints agree in
it. Hence 7 tables find every pair within 2 bits, without exception.

Equal fingerprints are one node, so copies never meet in pairs. A table's key
with many different fingerprints is divided again by a covering of the
positions that its mask leaves out, which again loses no pair; only the
comparison within 2 bits leaves a join.

Defined cases: null text is empty text, and a text without words has the
fingerprint zero, linked like any other. A row without an id keeps its
fingerprint; its component is the smallest id of its component, null if none of
its rows has one. Repeated ids each keep their own fingerprint; an id whose rows
differ does not link their components, only equal or near fingerprints do.
Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import smallest_reachable
from .rows import map_rows

BITS = 64
SEED = 42
#: More different fingerprints than this under one key are divided again.
CROWD = 256
#: Shingles whose bits are unpacked at once (64 bytes each).
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number.

    A bit is set if more than half of the shingles' hashes have it.
    """
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(words) - shingle + 1
        hashes = [digest(joined[s:e], SEED) for s, e in
                  zip(starts[:last].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    hashes = np.array(hashes, dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) of every row."""

    def work():
        return lambda rows: [(fingerprint(text, shingle),) for (text,) in rows]

    return map_rows(docs, [text_col], "fp long", work, keep=[id_col])


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``: any ``radius`` of them are missed by one mask."""
    space = 1 << (radius + 1)
    codes = {p: 1 + i % (space - 1) for i, p in enumerate(positions)}
    masks = []
    for vector in range(1, space):
        kept = [p for p in positions if (codes[p] & vector).bit_count() % 2]
        masks.append(sum(1 << p for p in kept))
    return masks


def nested_coverings(radius: int, depth: int) -> list[list[int]]:
    """Masks by level; the mask ``i`` of a level refines ``i // tables`` of the one above."""
    levels = [covering(list(range(BITS)), radius)]
    for _ in range(depth - 1):
        levels.append([
            mask | finer
            for mask in levels[-1]
            for finer in covering([p for p in range(BITS) if not mask >> p & 1], radius)
        ])
    return levels


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(codes: DataFrame, radius: int = 2, crowd: int = CROWD, depth: int = 3) -> DataFrame:
    """(a, b) with a < b for all different values of ``fp`` within ``radius`` bits.

    ``codes`` has one row for each different ``fp``.
    """
    levels = nested_coverings(radius, depth)
    tables = len(levels[0])
    rows = codes.select("fp", F.posexplode(_masks(levels[0])).alias("t", "mask"))
    found = []
    for level, masks in enumerate(levels):
        keyed = rows.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
        if level + 1 < depth:
            sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            few = keyed.join(sizes.filter(F.col("n") <= crowd).select("t", "k"), ["t", "k"], "left_semi")
            many = keyed.join(sizes.filter(F.col("n") > crowd).select("t", "k"), ["t", "k"], "left_semi")
            finer = _masks(levels[level + 1])
            own = F.slice(finer, F.col("t") * tables + 1, F.lit(tables))
            rows = many.select("fp", "t", F.posexplode(own).alias("s", "mask")).select(
                "fp", (F.col("t") * tables + F.col("s")).alias("t"), "mask")
        else:
            few = keyed
        found.append(_within(few, radius))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _within(keyed: DataFrame, radius: int) -> DataFrame:
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k"))
    return a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & near).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row; see the module's text."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    codes = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = smallest_reachable(near_pairs(codes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return named(marked, codes, roots, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(marked: DataFrame, codes: DataFrame, roots: DataFrame, code: str) -> DataFrame:
    """``marked`` (id, code) with component_id, from each code's first id and linked codes' roots."""
    linked = codes.join(roots, code)
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.select(code, "root").join(firsts, "root").select(code, "component_id")
    alone = codes.join(roots, code, "left_anti").select(code, F.col("first").alias("component_id"))
    # A code with very many copies is one hot key of this join; adaptive
    # execution splits it, as the other side has one row a key.
    return marked.join(known.union(alone), code)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that are their component's first; one for each component.

    Rows without an id are kept only if nothing in their component has an id
    (all of them, as nothing tells them apart). Repeated rows of one id become
    one: the one whose columns, as text, come first.
    """
    return first_rows(docs, near_duplicates(docs, id_col, text_col, shingle, radius), id_col)


def first_rows(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows that ``found`` (id, component_id) names as first; see ``keep_one``."""
    found = checkpointed(found)
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    mine = found.groupBy(F.col(id_col).alias("kept")).agg(
        F.max(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    mine = checkpointed(mine.filter("first").drop("first"))
    # packed, so that no column of the documents is taken for one of these
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    once = packed.join(mine.filter((F.col("copies") == 1) | F.col("kept").isNull()),
                       F.col("id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")
    again = packed.join(mine.filter((F.col("copies") > 1) & F.col("kept").isNotNull()),
                        F.col("id") == F.col("kept"), "left_semi").select("row.*")
    return once.unionByName(_first_of_id(again, id_col))


def _first_of_id(rows: DataFrame, id_col: str) -> DataFrame:
    others = [c for c in rows.columns if c != id_col]
    if not others:
        return rows.distinct()
    least = F.min(F.struct(*[F.col(c) for c in others])).alias("_row")
    return rows.groupBy(id_col).agg(least).select(
        *[F.col(c) if c == id_col else F.col("_row")[c].alias(c) for c in rows.columns])
