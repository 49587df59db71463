"""Ordered per-key computations that survive a key holding most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one
task. Here a key with more rows than one task should hold is cut into
consecutive *slices* of its order. Windows run per (key, slice); what has to
cross a slice border (a running total, the last rows, the last known value) is
computed on a small table with one row per slice and joined back on
(key, slice), the same columns the windows are partitioned by.

Cut points come from a hash sample of the order columns, so they depend only
on row content: recomputing a lost task gives the same slices. A cut is placed
every ``SAMPLES_PER_SLICE`` distinct sampled positions, hence every slice but
the first holds at least that many rows. Cuts compare the complete order, so
many rows with one timestamp are split by the id columns; only rows whose
whole order key is equal stay together.

When no key is that large the slice is constant and everything is a plain
window, without any join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .cuts import lookup

#: Session setting: most rows of one key that may share a task.
HOT_ROWS_SETTING = "buildlens.hotRows"
HOT_ROWS = 5_000_000
SAMPLES_PER_SLICE = 128
#: Bound on the total number of slices, and so on the broadcast cut table
#: (about 100 bytes a slice, 20 MB); the slice size grows beyond it.
MAX_SLICES = 200_000

SLICE = "_slice"
#: Prefix of the columns that carry values over slice borders.
CARRIED = "_carried_"


def hot_rows_of(df: DataFrame, hot_rows: int | None = None) -> int:
    if hot_rows is not None:
        return hot_rows
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def _key_known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def any_hot(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> bool:
    """Whether a key has more rows than one task should hold (one cheap count)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.filter(F.col("_n") > hot_rows_of(df, hot_rows)).isEmpty()


def _cut_table(df: DataFrame, keys: list[str], order: list[str], hot_rows: int):
    """(keys, order, number) of every cut of keys with more than ``hot_rows`` rows, or None."""
    sizes = (
        df.filter(_key_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
    )
    hot_total = sizes.agg(F.sum("_n")).first()[0]
    if not hot_total:
        return None
    hot_rows = max(hot_rows, hot_total // MAX_SLICES)
    every = max(1, hot_rows // SAMPLES_PER_SLICE)
    sample = (
        df.select(*keys, *order)
        .filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        .join(sizes.select(*keys), keys, "left_semi")
        .distinct()
    )
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    number = f"{CARRIED}no"
    return (
        sample.withColumn(number, nth)
        .filter(F.col(number) % SAMPLES_PER_SLICE == 0)
        .withColumn(number, (F.col(number) / SAMPLES_PER_SLICE).cast("int"))
    )


@dataclass(frozen=True)
class Timeline:
    """Rows with an order inside each key, possibly cut into slices.

    ``rows`` gains columns; ``base`` holds the same rows as they came in.
    Per-slice tables are computed from ``base``, so adding several features
    re-reads the input a fixed number of times instead of stacking the joins
    of one feature below those of the next.
    """

    rows: DataFrame
    base: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Iterable[str],
        order: Iterable[str],
        hot_rows: int | None = None,
        base: DataFrame | None = None,
        bounded: bool = False,
    ) -> Timeline:
        """Order ``df`` by ``order`` inside ``keys``.

        ``base`` may name a cheaper source with the same rows and the columns
        the features need (the scan that ``df`` was derived from). ``bounded``
        says that no key can be large by construction (rows of one fold), which
        saves the check.
        """
        keys, order = list(keys), list(order)
        if taken := [c for c in df.columns if c == SLICE or c.startswith(CARRIED)]:
            raise ValueError(f"reserved column names: {taken}")
        base = df if base is None else base
        cuts = None if bounded else _cut_table(base, keys, order, hot_rows_of(df, hot_rows))
        # Rows without a key get no result; they are spread instead of piled
        # into the null group.
        spread = F.pmod(F.xxhash64(*order), F.lit(4096)).cast("int")
        if cuts is None:
            slice_id = F.when(_key_known(keys), F.lit(0)).otherwise(spread)
            rows = df.withColumn(SLICE, slice_id)
            return cls(rows, rows, keys, order, split=False)
        # small (see MAX_SLICES) and used by every branch below
        tree = lookup(checkpointed(cuts), keys, order, CARRIED)
        slice_id = F.when(_key_known(keys), F.col(SLICE)).otherwise(spread)

        def cut(frame: DataFrame) -> DataFrame:
            return tree.slice_of(frame, SLICE).withColumn(SLICE, slice_id)

        rows = cut(df)
        return cls(rows, rows if base is df else cut(base), keys, order, split=True)

    # -- building blocks -----------------------------------------------------
    @property
    def _cell(self) -> list[str]:
        return [*self.keys, SLICE]

    @property
    def _ordered(self):
        return Window.partitionBy(*self._cell).orderBy(*self.order)

    @property
    def _slices(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _known(self, value: Column) -> Column:
        return F.when(_key_known(self.keys), value)

    def _per_slice(self, *aggregates: Column) -> DataFrame:
        return self.base.filter(_key_known(self.keys)).groupBy(*self._cell).agg(*aggregates)

    def _carry(self, rows: DataFrame, carried: DataFrame, needed: Column) -> DataFrame:
        """Join a per-slice table back; only slices with a predecessor matter.

        At most one row per slice of a hot key is left (see MAX_SLICES), and
        the join keys are the ones the windows are already partitioned by.
        """
        return rows.join(carried.filter(needed), self._cell, "left")

    def _with(self, rows: DataFrame) -> Timeline:
        return replace(self, rows=rows)

    def map(self, change) -> Timeline:
        """Apply a row-wise change that keeps the key, order and slice columns."""
        return self._with(change(self.rows))

    def rebased(self) -> Timeline:
        """Let later steps also use the columns added so far."""
        return replace(self, base=self.rows)

    def frame(self) -> DataFrame:
        return self.rows.drop(SLICE)

    # -- operators -----------------------------------------------------------
    def running(self, sums: Mapping[str, Column], exclude_current: bool = False) -> Timeline:
        """Add sums of all rows of the key up to this one."""
        end = -1 if exclude_current else 0
        frame = self._ordered.rowsBetween(Window.unboundedPreceding, end)
        rows = self.rows.select(
            "*", *[F.sum(v).over(frame).alias(name) for name, v in sums.items()]
        )
        if self.split:
            before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            # own columns have a prefix that the caller's names must not have
            own = {n: f"{CARRIED}{n}" for n in sums}
            totals = self._per_slice(*[F.sum(v).alias(own[n]) for n, v in sums.items()],
                                     F.lit(1).alias(CARRIED))
            carried = totals.select(
                *self._cell,
                F.sum(CARRIED).over(before).alias(CARRIED),
                *[F.sum(c).over(before).alias(c) for c in own.values()],
            )
            rows = self._carry(rows, carried, F.col(CARRIED).isNotNull())
            rows = rows.withColumns({
                # null only when neither part has a value, as one sum would be
                n: F.coalesce(F.col(n) + F.col(c), F.col(n), F.col(c)) for n, c in own.items()
            }).drop(CARRIED, *own.values())
        return self._with(rows.withColumns({n: self._known(F.col(n)) for n in sums}))

    def position(self, name: str) -> Timeline:
        """Add the 1-based position of the row inside its key."""
        rows = self.rows.withColumn(name, F.row_number().over(self._ordered).cast("long"))
        if self.split:
            before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            carried = self._per_slice(F.count(F.lit(1)).alias("_n")).select(
                *self._cell, F.sum("_n").over(before).alias("_before")
            )
            rows = self._carry(rows, carried, F.col("_before").isNotNull())
            rows = rows.withColumn(
                name, F.col(name) + F.coalesce("_before", F.lit(0))
            ).drop("_before")
        return self._with(rows.withColumn(name, self._known(F.col(name))))

    def head(self, name: str, count: int) -> Timeline:
        """Keep the first ``count`` rows of each key and add their position.

        Slices that start later are dropped before anything is sorted; the
        list of those is bounded like the cut table.
        """
        line = self
        if self.split:
            before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            late = (
                self._per_slice(F.count(F.lit(1)).alias("_n"))
                .withColumn("_before", F.sum("_n").over(before))
                .filter(F.col("_before") >= count)
                .select(*self._cell)
            )
            kept = self.rows.join(F.broadcast(late), self._cell, "left_anti")
            line = replace(self, rows=kept, base=kept if self.base is self.rows else
                           self.base.join(F.broadcast(late), self._cell, "left_anti"))
        return line.position(name).map(lambda rows: rows.filter(F.col(name) <= count))

    def previous(self, values: Mapping[str, Column]) -> Timeline:
        """Add values of the row just before this one, null on the first row."""
        window = self._ordered
        packed = F.struct(*[v.alias(n) for n, v in values.items()])
        rows = self.rows.withColumn("_lag", F.lag(packed).over(window))
        if self.split:
            last = self._per_slice(F.max_by(packed, F.struct(*self.order)).alias("_last"))
            carried = last.select(
                *self._cell, F.lag("_last").over(self._slices).alias("_last")
            )
            rows = self._carry(rows, carried, F.col("_last").isNotNull())
            # the lag struct is null exactly on the first row of a slice
            rows = rows.withColumn("_lag", F.coalesce("_lag", "_last")).drop("_last")
        return self._with(
            rows.withColumns({n: self._known(F.col(f"_lag.{n}")) for n in values}).drop("_lag")
        )

    def _tails(self, value: Column, length: int) -> DataFrame:
        """(keys, slice, _tail): the last ``length`` values before each slice.

        Only the last rows of every slice leave the map side (the rank filter
        is pushed below the exchange), so this stays at ``length`` per slice.
        """
        backwards = Window.partitionBy(*self._cell).orderBy(*[F.desc(c) for c in self.order])
        back = -(-length // SAMPLES_PER_SLICE)
        kept = (
            self.base.filter(_key_known(self.keys))
            .select(*self._cell, *self.order, F.struct(value.alias("v")).alias("_value"))
            .withColumn("_back", F.row_number().over(backwards))
            .filter(F.col("_back") <= length)
            .groupBy(*self._cell)
            .agg(F.sort_array(F.collect_list(F.struct(-F.col("_back"), "_value"))).alias("_tail"))
            .withColumn("_tail", F.transform("_tail", lambda t: t["_value"]["v"]))
        )
        joined = F.flatten(F.collect_list("_tail").over(self._slices.rowsBetween(-back, -1)))
        return (
            kept.withColumn("_tail", joined)
            .filter(F.size("_tail") > 0)
            .withColumn("_tail", _last(F.col("_tail"), F.lit(length)))
        )

    def history(self, name: str, value: Column, length: int) -> Timeline:
        """Add the array of the last ``length`` values *before* this row.

        ``value`` must not be null (collect_list skips nulls); pack nullable
        values into a struct or array. Early rows get a shorter array.
        """
        frame = self._ordered.rowsBetween(-length, -1)
        rows = self.rows.withColumn(name, F.collect_list(value).over(frame))
        if self.split:
            rows = self._carry(rows, self._tails(value, length), F.col("_tail").isNotNull())
            rows = rows.withColumn(
                name,
                F.when(
                    F.col("_tail").isNotNull() & (F.size(name) < length),
                    _last(F.concat("_tail", name), F.lit(length)),
                ).otherwise(F.col(name)),
            ).drop("_tail")
        return self._with(rows.withColumn(name, self._known(F.col(name))))

    def recent_mean(
        self, name: str, value: Column, length: int, exclude_current: bool = False
    ) -> Timeline:
        """Add the mean of the last ``length`` rows, nulls skipped."""
        value = value.cast("double")
        first, last = (-length, -1) if exclude_current else (1 - length, 0)
        frame = self._ordered.rowsBetween(first, last)
        if not self.split:
            rows = self.rows.withColumn(name, self._known(F.avg(value).over(frame)))
            return self._with(rows)
        here = F.row_number().over(self._ordered)
        rows = self.rows.select(
            "*",
            F.sum(value).over(frame).alias("_sum"),
            F.count(value).over(frame).alias("_cnt"),
            (F.lit(length) - here + (1 if exclude_current else 0)).alias("_missing"),
        )
        # ``_missing`` rows of the frame lie in earlier slices
        packed = F.struct(F.coalesce(value, F.lit(0.0)).alias("s"),
                          value.isNotNull().cast("long").alias("c"))
        rows = self._carry(rows, self._tails(packed, length), F.col("_tail").isNotNull())
        reach = F.when(F.col("_missing") > 0, _last(F.col("_tail"), F.col("_missing")))
        rows = rows.withColumn("_reach", reach)
        total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce(
            F.aggregate("_reach", F.lit(0.0), lambda a, t: a + t["s"]), F.lit(0.0))
        count = F.col("_cnt") + F.coalesce(
            F.aggregate("_reach", F.lit(0).cast("long"), lambda a, t: a + t["c"]),
            F.lit(0).cast("long"))
        rows = rows.withColumn(name, self._known(F.try_divide(total, count)))
        return self._with(rows.drop("_sum", "_cnt", "_missing", "_tail", "_reach"))

    def nearest_known(self, before: str, after: str, value: Column) -> Timeline:
        """Add the closest non-null ``value`` at or before / at or after the row.

        Two sorted passes, each with a running frame; a frame that ends at
        ``unboundedFollowing`` would be re-read for every row.
        """
        backwards = Window.partitionBy(*self._cell).orderBy(*[F.desc(c) for c in self.order])
        so_far = (Window.unboundedPreceding, 0)
        rows = self.rows.withColumn(
            before, F.last(value, ignorenulls=True).over(self._ordered.rowsBetween(*so_far))
        ).withColumn(
            after, F.last(value, ignorenulls=True).over(backwards.rowsBetween(*so_far))
        )
        if self.split:
            here = F.struct(*self.order)
            ends = self._per_slice(
                F.max_by(value, F.when(value.isNotNull(), here)).alias("_lastv"),
                F.min_by(value, F.when(value.isNotNull(), here)).alias("_firstv"),
            )
            past = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            future = Window.partitionBy(*self.keys).orderBy(F.desc(SLICE)).rowsBetween(
                Window.unboundedPreceding, -1)
            carried = ends.select(
                *self._cell,
                F.last("_lastv", ignorenulls=True).over(past).alias("_pastv"),
                F.last("_firstv", ignorenulls=True).over(future).alias("_nextv"),
            )
            needed = F.col("_pastv").isNotNull() | F.col("_nextv").isNotNull()
            rows = self._carry(rows, carried, needed)
            rows = rows.withColumns({
                before: F.coalesce(before, "_pastv"),
                after: F.coalesce(after, "_nextv"),
            }).drop("_pastv", "_nextv")
        return self._with(rows.withColumns({c: self._known(F.col(c)) for c in (before, after)}))


def _last(array: Column, count: Column) -> Column:
    """The last ``count`` elements, or all of a shorter array."""
    start = F.greatest(F.size(array) - count + 1, F.lit(1))
    return F.slice(array, start, F.greatest(count, F.lit(0)))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    fractions: list[float],
    names: list[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per key without one task holding a large key's values.

    The built-in percentile keeps a key's distinct values in memory, which is
    fine up to the size that is checked here. For larger keys equal values are
    counted first (combined on the map side), then running counts locate the
    wanted positions. Rows with a null key or value take no part.
    """
    if keys:
        df = df.filter(_key_known(keys))
    if not any_hot(df, keys, hot_rows):
        found = df.groupBy(*keys).agg(
            F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(f)) for f in fractions]))
            .alias("_q")).filter(F.col("_q").isNotNull())
        return found.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    at_keys = keys or ["_all"]
    if not keys:
        counts = counts.withColumn("_all", F.lit(1))
    totals = counts.groupBy(*at_keys).agg(F.sum("_c").alias("_n"))
    line = Timeline.of(counts, at_keys, ["_v"], hot_rows).running({"_upto": F.col("_c")})
    placed = line.frame().join(totals, at_keys)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    picks = []
    for fraction, name in zip(fractions, names, strict=True):
        spot = (F.col("_n") - 1) * F.lit(float(fraction))
        for end, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (first <= rank) & (rank <= last)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{end}"))
    found = placed.groupBy(*at_keys, "_n").agg(*picks)
    result = []
    for fraction, name in zip(fractions, names, strict=True):
        spot = (F.col("_n") - 1) * F.lit(float(fraction))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*keys, *result)
