"""Sliding folds and fixed-length windows over a project's time line."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import FEATURE_GROUPS, LABEL, PROJECT, TIME_ORDER
from ..session import checkpointed
from .timeline import Timeline

TRAIN, TEST = "train", "test"


# -- folds --------------------------------------------------------------------
def assign_folds(
    df: DataFrame, position: str, rows_in_key: str, n_folds: int = 10, window: int = 1000,
    step: int = 600,
) -> DataFrame:
    """One row per fold whose range holds the 0-based ``position``.

    Folds overlap, so this is a range join; as the ranges are an arithmetic
    series, the matching fold numbers are computed instead of joined. A fold
    is kept only if its test part ends within the key.
    """
    span = window + int(window * 0.2)
    at = F.col(position)
    first = F.greatest(F.floor((at - span) / F.lit(step)) + 1, F.lit(0))
    last = F.least(F.floor(at / F.lit(step)), F.lit(n_folds - 1))
    # folds whose test part fits: fold * step + span <= rows
    last = F.least(last, F.floor((F.col(rows_in_key) - span) / F.lit(step)))
    folds = F.when(first <= last, F.sequence(first, last))
    offset = at - F.col("_fold") * step
    return (
        df.withColumn("_fold", F.explode(folds))
        .withColumn("split", F.when(offset < window, TRAIN).otherwise(TEST))
        .withColumn("fold", (F.col("_fold") + 1).cast("int"))
        .drop("_fold")
    )


def online_folds(
    df: DataFrame, n_folds: int = 10, window: int = 1000, step: int = 600,
    project: str = PROJECT, order: Iterable[str] = TIME_ORDER,
) -> DataFrame:
    """Rows of every sliding train/test fold, with ``fold`` (from 1), ``split``
    and the 0-based ``position`` in the project.

    No fold reaches past a fixed position, so only that many rows of each
    project are looked at, however large it is.
    """
    reach = (n_folds - 1) * step + window + int(window * 0.2)
    head = Timeline.of(df, [project], order).head("position", reach).frame()
    head = head.filter(F.col(project).isNotNull()).withColumn("position", F.col("position") - 1)
    # at most ``reach`` rows a project are left
    counted = head.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(project)))
    return assign_folds(counted, "position", "_rows", n_folds, window, step).drop("_rows")


def fold_class_distribution(folds: DataFrame, project: str = PROJECT) -> DataFrame:
    from .profile import class_distribution

    return class_distribution(folds, [project, "fold", "split"])


# -- windows ------------------------------------------------------------------
def feature_vector(features: Iterable[str]) -> Column:
    """Features of one time step; a missing value counts as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def windowed(
    df: DataFrame, features: list[str], length: int, keys: list[str], order: list[str],
    bounded: bool = False, position: str | None = None,
) -> DataFrame:
    """Every row with up to ``length`` feature rows before it, as ``window``.

    ``position`` names a column for the row's 1-based place in its key.
    """
    line = Timeline.of(df, keys, order, bounded=bounded)
    if position is not None:
        line = line.position(position)
    return line.history("window", feature_vector(features), length).frame()


def train_windows(
    df: DataFrame, features: list[str], length: int, keys: Iterable[str] = (PROJECT,),
    order: Iterable[str] = TIME_ORDER, bounded: bool = False, position: str | None = None,
) -> DataFrame:
    """One row per complete window: the ``length`` rows before a row, and its
    label. A key of n rows gives n - length windows, or none."""
    rows = windowed(df, features, length, list(keys), list(order), bounded, position)
    return rows.filter(F.size("window") == length)


#: Least rows of a block, and most cells of the windows that a task cuts from its blocks.
BLOCK_ROWS, TASK_CELLS = 1_000, 2_000_000


def window_blocks(
    df: DataFrame, features: list[str], length: int, total: int, project: str = PROJECT,
    order: Iterable[str] = TIME_ORDER, label: str = LABEL,
) -> DataFrame:
    """The time line of one project of ``total`` rows in blocks, each with the ``length`` rows before it.

    Blocks are as small as the rows. They lie in as many tasks as the windows need that
    are cut from them, which have ``length`` times the cells.
    """
    order, size = list(order), max(BLOCK_ROWS, length)
    rows = df.select(
        project, *order, feature_vector(features).alias("x"),
        F.col(label).cast("double").alias("label"))
    line = Timeline.of(rows, [project], order).position("at").frame()
    block, place = F.floor((F.col("at") - 1) / size), (F.col("at") - 1) % size
    # the last rows of a block are also those before the next one
    placed = line.filter(F.col(project).isNotNull()).select("at", "x", "label", F.explode(
        F.when(place >= size - length, F.array(block, block + 1)).otherwise(F.array(block))
    ).alias("block"))
    tasks = ceil(total * length * len(features) / TASK_CELLS) or 1
    packed = placed.repartition(tasks, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "x", "label"))).alias("rows"))
    return packed.select(
        (F.col("block") * size).alias("after"), F.get("rows.at", F.lit(0)).alias("first"),
        F.flatten("rows.x").alias("cells"), F.col("rows.label").alias("labels"))


def windows_of(blocks: DataFrame, length: int, width: int) -> DataFrame:
    """(at, label, cells) of the windows that blocks hold, at most as long as their rows before.

    These are the ``train_windows``, as flat arrays."""
    start = (F.col("_i") - length) * width + 1
    rows = blocks.select("after", "first", "cells", F.posexplode("labels").alias("_i", "label"))
    placed = rows.withColumn("at", F.col("first") + F.col("_i")).filter(
        (F.col("at") > F.col("after")) & (F.col("at") > length))
    return placed.select("at", "label", F.slice("cells", start, length * width).alias("cells"))


def zero_rows(count: Column, width: int) -> Column:
    return F.array_repeat(F.array(*[F.lit(0.0)] * width), count)


def test_windows(
    df: DataFrame, features: list[str], length: int, keys: Iterable[str] = (PROJECT,),
    order: Iterable[str] = TIME_ORDER, split: str = "split", bounded: bool = False,
) -> DataFrame:
    """One window per test row over train and test rows before it; short
    windows get zero rows on the left. ``split`` tells train from test."""
    # train rows come before test rows whatever their time
    ranked = df.withColumn("_part", F.when(F.col(split) == TEST, 1).otherwise(0))
    rows = windowed(ranked, features, length, list(keys), ["_part", *order], bounded)
    padded = F.concat(
        zero_rows(F.lit(length) - F.size("window"), len(features)), F.col("window"))
    return rows.filter(F.col(split) == TEST).withColumn("window", padded).drop("_part")


test_windows.__test__ = False  # not a pytest test


def group_window(
    window: Column, features: list[str], groups: Mapping[str, list[str]] = FEATURE_GROUPS
) -> Column:
    """Each time step as groups x slots, zero padded; absent features are skipped."""
    places = [[features.index(f) for f in names if f in features] for names in groups.values()]
    slots = max(len(p) for p in places)

    def grid(step: Column) -> Column:
        return F.array(*[
            F.array(*[step[i] for i in p], *[F.lit(0.0)] * (slots - len(p))) for p in places
        ])

    return F.transform(window, grid)


def border_rows(window: Column, border: int = 3) -> Column:
    """The first and last rows of a window as one flat vector."""
    return F.flatten(F.concat(F.slice(window, 1, border), F.slice(window, -border, border)))


def border_names(features: Iterable[str], border: int = 3) -> list[str]:
    features = list(features)
    return [f"{side}_{i}:{name}" for side in ("head", "tail") for i in range(border)
            for name in features]


def border_windows(
    df: DataFrame, features: list[str], length: int = 40, max_samples: int | None = None,
    project: str = PROJECT, order: Iterable[str] = TIME_ORDER, zeroed: Iterable[str] = (),
) -> DataFrame:
    """Windows, by ``position`` in their project, with their unscaled border ``target``.

    With ``max_samples`` only the first ones in (project, position) order; it
    then also bounds what has to be read of a project, so windows are only
    built for rows that can be among the chosen ones.
    """
    zeroed = set(zeroed)
    masked = df.withColumns({c: F.lit(0.0) for c in features if c in zeroed})
    if max_samples is None:
        windows = train_windows(masked, features, length, [project], order, position="position")
        return windows.withColumn("target", border_rows(F.col("window")))
    line = Timeline.of(masked, [project], order).head("position", max_samples + length)
    rows = line.frame().filter(F.col(project).isNotNull())
    chosen = (
        rows.filter(F.col("position") > length)
        .select(project, "position").orderBy(project, "position").limit(max_samples)
    )
    needed = chosen.groupBy(project).agg(F.max("position").alias("_last"))
    kept = rows.join(needed, project).filter(F.col("position") <= F.col("_last")).drop("_last")
    windows = train_windows(kept, features, length, [project], ["position"], bounded=True)
    return windows.withColumn("target", border_rows(F.col("window")))


def masked_windows(df: DataFrame, features: list[str], zeroed: Iterable[str]) -> DataFrame:
    """Windows whose ``zeroed`` features are 0 in every step, and their ``target``."""
    zeroed = set(zeroed)
    if zeroed:
        df = df.withColumn("window", F.transform("window", lambda step: F.array(*[
            F.lit(0.0) if c in zeroed else step[i] for i, c in enumerate(features)])))
    return df.withColumn("target", border_rows(F.col("window")))


def scale_targets(df: DataFrame, width: int, vector: str = "target") -> DataFrame:
    """Scale every element of a vector column to [0, 1] over all rows.

    Adds ``low`` and ``high``, the fitted bounds, from one aggregate row, which
    is computed once for all that is done with the result.
    """
    bounds = C.only_row(checkpointed(df.agg(
        F.array(*[F.min(F.get(vector, F.lit(i))) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.get(vector, F.lit(i))) for i in range(width)]).alias("high"),
    )))

    def scale(value: Column, i: Column) -> Column:
        low, high = F.get("low", i), F.get("high", i)
        return (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))

    bounded = df.withColumns({"low": bounds["low"], "high": bounds["high"]})
    return bounded.withColumn(vector, F.transform(vector, scale))


def border_targets(
    df: DataFrame, features: list[str], length: int = 40, max_samples: int | None = None,
    **options
) -> DataFrame:
    """Border windows with targets scaled to [0, 1]."""
    windows = border_windows(df, features, length, max_samples, **options)
    return scale_targets(windows, 6 * len(features))


def chrono_split(
    df: DataFrame, train_share: float = 0.8, keys: Iterable[str] = (PROJECT,),
    order: Iterable[str] = TIME_ORDER,
) -> DataFrame:
    """Mark the first share of each key's rows as train, the rest as validation.

    The validation part is rounded up.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = Timeline.of(df, keys, order).position("_at").frame().join(sizes, keys)
    held = F.ceil(F.round(F.col("_n") * F.lit(1.0 - train_share), 9))
    part = F.when(F.col("_at") <= F.col("_n") - held, TRAIN).otherwise("validation")
    return rows.withColumn("part", part).drop("_at", "_n")


def held_out(count: int, share: float = 0.2) -> int:
    return ceil(round(count * share, 9))
