"""Rebalancing training sets with synthetic minority rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABEL
from ..session import checkpointed
from .timeline import Timeline

BLOCK = 2_000


def minority(df: DataFrame, keys: list[str], label: str = LABEL) -> DataFrame:
    """Per key with two classes of different size: minority label, sizes, and
    the number of rows missing to parity."""
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    counts = df.groupBy(*keys).agg(zero.alias("_zero"), one.alias("_one"))
    small = F.least("_zero", "_one")
    return counts.filter((small > 0) & (F.col("_zero") != F.col("_one"))).select(
        *keys, F.when(F.col("_zero") < F.col("_one"), 0).otherwise(1).alias("_minority"),
        small.alias("_size"), (F.greatest("_zero", "_one") - small).alias("_missing"))


def _minority_rows(
    df: DataFrame, keys: list[str], vector: str, ident: str, label: str, bounded: bool
) -> DataFrame:
    small = minority(df, keys, label)
    rows = df.join(small, keys).filter(F.col(label) == F.col("_minority"))
    rows = rows.select(*keys, ident, vector, "_minority", "_size", "_missing")
    line = Timeline.of(rows, keys, [ident], bounded=bounded)
    return line.position("_nth").frame()


def _nearest(k: int, n_keys: int):
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one block's rows for each row of another block."""
        names = list(left.columns[:n_keys])
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*names, "id", "neighbour", "distance"])
        a, b = np.stack(left["vector"]), np.stack(right["vector"])
        distance = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            distance += (a[:, i, None] - b[None, :, i]) ** 2
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        distance[ids[:, None] == others[None, :]] = np.inf
        # ties go to the smaller id
        by_id = np.argsort(others, kind="stable")
        best = by_id[np.argsort(distance[:, by_id], axis=1, kind="stable")[:, :k]]
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        flat = best.ravel()
        found = pd.DataFrame({
            **{n: left[n].iloc[0] for n in names}, "id": ids[rows], "neighbour": others[flat],
            "distance": np.sqrt(distance[rows, flat]),
        }, index=np.arange(len(rows)))
        return found[np.isfinite(found["distance"])]

    return nearest


def minority_knn(
    df: DataFrame, keys: Iterable[str], vector: str, ident: str, label: str = LABEL, k: int = 5,
    block: int = BLOCK, bounded: bool = False,
) -> DataFrame:
    """(keys, id, neighbours): the k nearest minority rows of each minority row.

    Rows of a key lie in blocks along a space-filling order. Each block is first
    searched for its own rows; after that a row's k-th distance so far tells which
    other blocks may hold nearer ones, by their bounding boxes. Only these pairs of
    blocks are compared. The result is exact for any key size, no task holds more than
    two blocks, and no pairs of rows are written out. ``bounded`` says that keys
    are small by construction.
    """
    keys = list(keys)
    rows = _minority_rows(df, keys, vector, ident, label, bounded)
    return _knn_of(rows, keys, vector, ident, k, block, bounded)


#: Columns that order the blocks, and bits of each of them.
ORDERING, BITS = 6, 10


def _along_space(rows: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """``rows`` (keys, id, vector) with ``_at``, their place from 1 along a Z-order of
    the columns that vary most."""
    cells = rows.select(*keys, F.posexplode("vector").alias("_dim", "_x"))
    spans = cells.groupBy(*keys, "_dim").agg(
        F.variance("_x").alias("_var"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    widest = F.sort_array(F.collect_list(F.struct((-F.col("_var")).alias("_var"), "_dim", "_lo", "_hi")))
    spans = spans.groupBy(*keys).agg(F.slice(widest, 1, ORDERING).alias("_spans"))
    place = F.lit(0).cast("long")
    for j in range(ORDERING):
        span = F.get("_spans", F.lit(j))
        share = F.try_divide(F.get("vector", span["_dim"]) - span["_lo"], span["_hi"] - span["_lo"])
        # not a number is above 1
        step = F.when((share >= 0) & (share <= 1), F.floor(share * (2**BITS - 1))).otherwise(0).cast("long")
        for bit in range(BITS):
            place = place.bitwiseOR(F.shiftleft(
                F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), bit * ORDERING + j))
    placed = rows.join(spans, keys, "left").withColumn("_z", F.coalesce(place, F.lit(0))).drop("_spans")
    return Timeline.of(placed, keys, ["_z", "id"], bounded=bounded).position("_at").frame()


def _boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _own, _n, _box): rows and bounds in every column of each block."""
    cells = rows.select(*keys, "_own", F.posexplode("vector").alias("_dim", "_x")).groupBy(
        *keys, "_own", "_dim").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(*keys, "_own").agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_dim", "lo", "hi"))).alias("_box"))


def block_visits(rows: DataFrame, own: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, _a, _b): blocks ``_b`` that may hold one of the k nearest of a row of ``_a``.

    ``own`` are the (keys, _own, id, neighbour, distance) found inside the blocks.
    """
    each = own.groupBy(*keys, "_own", "id").agg(F.count(F.lit(1)).alias("_found"), F.max("distance").alias("_far"))
    reach = each.groupBy(*keys, "_own").agg(F.count_if(F.col("_found") >= k).alias("_full"), F.max("_far").alias("_far"))
    boxes = _boxes(rows, keys)
    # a block with a row of fewer than k so far reaches everywhere
    a = boxes.join(reach, [*keys, "_own"], "left").select(
        *keys, F.col("_own").alias("_a"), F.col("_box").alias("_box_a"),
        F.when(F.col("_full") == F.col("_n"), F.col("_far")).alias("_far"))
    b = boxes.select(*keys, F.col("_own").alias("_b"), F.col("_box").alias("_box_b"))
    gaps = F.zip_with("_box_a", "_box_b", lambda x, y: F.greatest(F.lit(0.0), y["lo"] - x["hi"], x["lo"] - y["hi"]))
    apart = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))
    # equally near rows count, and rounding must not lose any
    near = F.col("_far").isNull() | F.isnan(apart) | (apart * (1 - 1e-9) <= F.col("_far"))
    return a.join(b, keys).filter((F.col("_a") != F.col("_b")) & near).select(*keys, "_a", "_b")


def _knn_of(
    rows: DataFrame, keys: list[str], vector: str, ident: str, k: int, block: int, bounded: bool = False,
) -> DataFrame:
    # read by the steps below; written once
    rows = checkpointed(rows.select(
        *keys, F.col(ident).alias("id"), F.col(vector).alias("vector"), (F.col("_size") > block).alias("_parted")))
    # only keys of several blocks need an order
    place = _along_space(rows.filter("_parted"), keys, bounded)
    parted = checkpointed(place.select(
        *keys, F.floor((F.col("_at") - 1) / F.lit(block)).cast("int").alias("_own"), "id", "vector"))
    rows = parted.union(rows.filter("NOT _parted").select(*keys, F.lit(0).alias("_own"), "id", "vector"))
    key_fields = [rows.schema[key] for key in keys]
    id_type = rows.schema["id"].dataType
    found = [T.StructField("id", id_type), T.StructField("neighbour", id_type),
             T.StructField("distance", T.DoubleType())]
    whole = T.StructType([*key_fields, T.StructField("_own", T.IntegerType()), *found])
    search = _nearest(k, len(keys) + 1)
    own = checkpointed(rows.groupBy(*keys, "_own").applyInPandas(lambda part: search(part, part), whole))
    # small: one row for each pair of blocks that is compared
    visits = checkpointed(block_visits(parted, own, keys, k))
    columns = [*keys, "_a", "_b"]
    left = parted.withColumnRenamed("_own", "_a").join(visits, [*keys, "_a"]).select(*columns, "id", "vector")
    # fresh aliases: both sides stem from the same table
    right = parted.withColumnRenamed("_own", "_b").join(visits, [*keys, "_b"]).select(
        *[F.col(c).alias(c) for c in (*columns, "id", "vector")])
    schema = T.StructType([
        *key_fields, T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType()), *found])
    pairs = left.groupBy(*columns).cogroup(right.groupBy(*columns)).applyInPandas(
        _nearest(k, len(columns)), schema)
    ranked = F.sort_array(F.collect_list(F.struct("distance", "neighbour")))
    # k candidates for each block compared: a short list
    return own.drop("_own").union(pairs.drop("_a", "_b")).groupBy(*keys, "id").agg(
        F.slice(ranked, 1, k).alias("neighbours"))


def smote_balance(
    df: DataFrame, keys: Iterable[str], vector: str, ident: str, label: str = LABEL, k: int = 5,
    seed: int = 42, enabled: bool = True, block: int = BLOCK, bounded: bool = False,
) -> DataFrame:
    """(keys, id, vector, label, synthetic): the rows of each key and enough
    synthetic minority rows to reach parity.

    A synthetic row lies between a minority row and one of its k nearest
    neighbours, chosen by a hash of the row and ``seed``. Keys with one class
    stay as they are. Order by (synthetic, id) to have real rows first.
    """
    keys = list(keys)
    real = df.select(
        *keys, F.col(ident).alias("id"), F.col(vector).alias("vector"),
        F.col(label).cast("int").alias("label"), F.lit(0).alias("synthetic"))
    if not enabled:
        return real
    # read three times below; written once, so that the input is not
    bases = checkpointed(_minority_rows(df, keys, vector, ident, label, bounded))
    # bases take turns: row i of m makes one synthetic row per round it is in
    turns = F.floor((F.col("_missing") - F.col("_nth")) / F.col("_size")) + 1
    made = (
        bases.filter(turns > 0)
        .select(*keys, F.col(ident).alias("id"), F.col(vector).alias("_base"), "_minority",
                F.explode(F.sequence(F.lit(1).cast("long"), turns)).alias("_turn"))
        .join(_knn_of(bases, keys, vector, ident, k, block, bounded), [*keys, "id"], "left")
    )
    draw = F.xxhash64("id", "_turn", F.lit(seed))
    count = F.coalesce(F.size("neighbours"), F.lit(0))
    pick = F.when(count > 0, F.get("neighbours", F.pmod(draw, count).cast("int"))["neighbour"])
    share = F.pmod(F.xxhash64("id", "_turn", F.lit(seed + 1)), F.lit(1_000_000)) / F.lit(1e6)
    made = made.select(
        *keys, "id", "_turn", "_base", "_minority", F.coalesce(pick, F.col("id")).alias("_pick"),
        share.alias("_share"))
    others = bases.select(*keys, F.col(ident).alias("_pick"), F.col(vector).alias("_near"))
    between = F.zip_with("_base", "_near", lambda a, b: a + F.col("_share") * (b - a))
    synthetic = made.join(others, [*keys, "_pick"]).select(
        *keys, "id", between.alias("vector"), F.col("_minority").alias("label"),
        F.col("_turn").cast("int").alias("synthetic"))
    return real.union(synthetic)


def pad_short(
    df: DataFrame, keys: Iterable[str], vector: str, ident: str, label: str, length: int
) -> DataFrame:
    """(keys, ident, vector, label) where keys with fewer than ``length`` rows
    get rows of zeros, labelled 0, in front. ``ident`` numbers rows from 1."""
    keys = list(keys)
    rows = df.select(
        *keys, F.col(ident).cast("long").alias(ident), vector, F.col(label).cast("int").alias(label))
    short = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.size(vector)).alias("_width"),
    ).filter(F.col("_n") < length)
    pads = short.select(
        *keys, F.explode(F.sequence(F.col("_n") - length + 1, F.lit(0).cast("long"))).alias(ident),
        F.array_repeat(F.lit(0.0), F.col("_width")).alias(vector), F.lit(0).alias(label))
    return rows.union(pads)


def smote_windows(
    df: DataFrame, keys: Iterable[str], vector: str, ident: str, length: int, label: str = LABEL,
    k: int = 5, seed: int = 42, bounded: bool = False,
) -> DataFrame:
    """Training windows over a rebalanced sequence: real rows, then synthetic ones.

    Late windows hold synthetic rows; weights are the alternative (see the
    ``balance`` option of the window classifier). Short keys are padded first.
    """
    keys = list(keys)
    padded = pad_short(df, keys, vector, ident, label, length)
    balanced = smote_balance(padded, keys, vector, ident, label, k, seed, bounded=bounded)
    line = Timeline.of(balanced, keys, ["synthetic", "id"], bounded=bounded)
    rows = line.history("window", F.col("vector"), length).frame()
    return rows.filter(F.size("window") == length).select(*keys, "id", "synthetic", "label", "window")
