"""Which slice of its key a row belongs to, found by hash joins.

The cut points of a key's order are kept as a tree of small broadcast tables.
A node covers some consecutive cuts and deals their span in one order column
into as many parts of equal width as it has cuts; an equality join on (key,
node, part) leads a row one level down, or to the few intervals between the
cuts of its part, of which a condition on the complete order picks one. A part
with more than ``FEW`` cuts is a node of its own: of the same column if the
cuts differ in it, so that outliers do no harm, else of the next column, so
that very many rows with one time stamp do none either.

Rows carry a fixed number of small columns and all of it is generated code.
Beyond ``LEVELS`` levels, or where values are too close to tell by their
numbers, the intervals of a part are more; the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

#: Cuts that a part may have without being divided again.
FEW = 4
#: Levels of nodes below the root; a path has ``PART_BITS`` for each of them.
LEVELS = 3
PART_BITS = 18
MOST_PARTS = 100_000

_LOWEST = -(1 << 63)
_FAR = float(1 << 62)


def code(kind: T.DataType, value: Column) -> Column:
    """A number that never falls along the order of a column; null first."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        number = value.cast("int" if isinstance(kind, T.BooleanType) else "long").cast("long")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        number = F.unix_date(value).cast("long")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        # in steps of 2 ** -20; not a number is the greatest value
        scaled = F.floor(F.least(F.greatest(value.cast("double") * (1 << 20), F.lit(-_FAR)), F.lit(_FAR)))
        number = F.when(F.isnan(value.cast("double")), F.lit(1 << 62)).otherwise(scaled).cast("long")
    elif isinstance(kind, T.StringType):
        number = F.conv(F.rpad(F.substring(F.hex(value), 1, 14), 14, "0"), 16, 10).cast("long")
    else:
        number = F.lit(0).cast("long")
    return F.coalesce(number, F.lit(_LOWEST).cast("long"))


def _chosen(column: Column, values: list[Column]) -> Column:
    found = values[0]
    for i, value in enumerate(values[1:], 1):
        found = F.when(column == i, value).otherwise(found)
    return found


def _part(column: Column, lo: Column, hi: Column, parts: Column, at: Column, here: list[Column],
          codes: list[Column], names: list[str]) -> Column:
    """The part of a node that a row lies in: -1 before its cuts, ``parts`` behind them.

    Never falls along the order: a row that differs from the node's cuts in
    the column before the node's own is before or behind all of them.
    """
    number = _chosen(column, codes)
    share = (number.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))
    inside = F.when(hi.cast("double") == lo.cast("double"), 0).otherwise(
        F.least(F.floor(share * parts).cast("int"), parts - 1))
    part = F.when(number < lo, -1).when(number > hi, parts).otherwise(inside)
    for i in range(1, len(here)):
        # as structs, whose order knows nulls
        row, node = F.struct(here[i - 1].alias("v")), F.struct(at[names[i - 1]].alias("v"))
        part = F.when((column == i) & (row < node), -1).when((column == i) & (row > node), parts).otherwise(part)
    return part


@dataclass(frozen=True)
class Lookup:
    """The tables of a tree of cuts; their rows are at most about four a cut."""

    roots: DataFrame
    steps: list[DataFrame]
    intervals: DataFrame
    keys: list[str]
    order: list[str]
    mark: str

    def slice_of(self, frame: DataFrame, name: str) -> DataFrame:
        """``frame`` with the number of cuts at or before each row; 0 for keys without cuts."""
        m = self.mark
        here = [F.col(c) for c in self.order]
        codes = [code(frame.schema[c].dataType, F.col(c)) for c in self.order]

        def meets(table: DataFrame, *at: str) -> tuple[DataFrame, Column]:
            table = table.select(*[F.col(c).alias(f"{m}t_{c}") for c in table.columns])
            on = F.lit(True)
            for c in (*self.keys, *at):
                on = on & (F.col(c) == F.col(f"{m}t_{c}"))
            return F.broadcast(table), on

        def of(column: str) -> Column:
            return F.col(f"{m}t_{m}{column}")

        def part() -> Column:
            return _part(of("col"), of("lo"), of("hi"), of("parts"), of("at"), here, codes, self.order)

        table, on = meets(self.roots)
        rows = frame.join(table, on, "left").select(
            *frame.columns, of("path").alias(f"{m}path"), part().alias(f"{m}part"))
        for step in self.steps:
            table, on = meets(step, f"{m}path", f"{m}part")
            rows = rows.join(table, on, "left").select(
                *frame.columns, F.coalesce(of("child"), F.col(f"{m}path")).alias(f"{m}path"),
                F.when(of("child").isNotNull(), part()).otherwise(F.col(f"{m}part")).alias(f"{m}part"))
        table, on = meets(self.intervals, f"{m}path", f"{m}part")
        row = F.struct(*here)
        on = on & (of("from").isNull() | (of("from") <= row)) & (of("to").isNull() | (row < of("to")))
        return rows.join(table, on, "left").select(
            *frame.columns, F.coalesce(of("slice"), F.lit(0)).alias(name))


def lookup(cuts: DataFrame, keys: list[str], order: list[str], mark: str) -> Lookup:
    """The tree of ``cuts``: (keys, order columns, ``mark`` + "no"), numbered from 1 in each key.

    ``cuts`` is small and cheap to read; ``mark`` begins no column name of the rows.
    """
    path, column, part, no = (f"{mark}{c}" for c in ("path", "col", "part", "no"))
    here = [F.col(c) for c in order]
    codes = [code(cuts.schema[c].dataType, F.col(c)) for c in order]
    node = [*keys, path]
    left = cuts.withColumns({path: F.lit(1).cast("long"), column: F.lit(0)})
    roots, steps, found = None, [], []
    for level in range(LEVELS + 1):
        number = _chosen(F.col(column), codes)
        nodes = left.groupBy(*node, column).agg(
            F.min(number).alias(f"{mark}lo"), F.max(number).alias(f"{mark}hi"),
            F.least(F.count(F.lit(1)), F.lit(MOST_PARTS)).cast("int").alias(f"{mark}parts"),
            F.min(F.struct(*here)).alias(f"{mark}at"), F.min(no).alias(f"{mark}first"))
        dealt = left.join(nodes.drop(column), node).withColumn(part, _part(
            F.col(column), F.col(f"{mark}lo"), F.col(f"{mark}hi"), F.col(f"{mark}parts"), F.col(f"{mark}at"),
            here, codes, order))
        value = [F.min(F.struct(c)) == F.max(F.struct(c)) for c in order]
        parts = dealt.groupBy(*node, column, part).agg(
            F.count(F.lit(1)).alias(f"{mark}n"), F.min(F.struct(*here)).alias(f"{mark}least"),
            F.max(no).alias(f"{mark}last"), (F.min(number) < F.max(number)).alias(f"{mark}differ"),
            _chosen(F.first(column), value).alias(f"{mark}same"))
        following = F.when(F.col(f"{mark}differ"), F.col(column)).when(
            F.col(f"{mark}same") & (F.col(column) + 1 < len(order)), F.col(column) + 1)
        crowded = (F.col(f"{mark}n") > FEW) & (level < LEVELS)
        parts = checkpointed(parts.withColumn(f"{mark}next", F.when(crowded, following)).withColumn(
            f"{mark}child", F.when(F.col(f"{mark}next").isNotNull(), F.shiftleft(path, PART_BITS).bitwiseOR(
                F.col(part).cast("long") + 1))))
        divided = parts.filter(F.col(f"{mark}child").isNotNull())
        bounds = [f"{mark}lo", f"{mark}hi", f"{mark}parts", f"{mark}at"]
        if level == 0:
            roots = nodes.select(*node, column, *bounds)
        else:
            steps[-1] = steps[-1].join(
                nodes.select(*keys, F.col(path).alias(f"{mark}child"), column, *bounds), [*keys, f"{mark}child"])
        # what lies before the first cut of every part that is not divided
        every = nodes.select(*node, f"{mark}first", F.explode(F.sequence(F.lit(-1), f"{mark}parts")).alias(part))
        so_far = Window.partitionBy(*node).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        begin = every.join(parts.drop(column), [*node, part], "left").withColumn(f"{mark}slice", F.coalesce(
            F.last(f"{mark}last", ignorenulls=True).over(so_far), F.col(f"{mark}first") - 1))
        row = T.StructType([cuts.schema[c] for c in order])
        found.append(begin.filter(F.col(f"{mark}child").isNull()).select(
            *node, part, F.lit(None).cast(row).alias(f"{mark}from"), F.col(f"{mark}least").alias(f"{mark}to"),
            F.col(f"{mark}slice").cast("int").alias(f"{mark}slice")))
        in_part = Window.partitionBy(*node, part).orderBy(no)
        found.append(dealt.join(divided.select(*node, part), [*node, part], "left_anti").select(
            *node, part, F.struct(*here).alias(f"{mark}from"),
            F.lead(F.struct(*here)).over(in_part).alias(f"{mark}to"), F.col(no).cast("int").alias(f"{mark}slice")))
        if level == LEVELS or divided.isEmpty():
            break
        steps.append(divided.select(*node, part, f"{mark}child"))
        left = checkpointed(dealt.select(*cuts.columns, path, part).join(divided.select(
            *node, part, f"{mark}child", f"{mark}next"), [*node, part]).select(
            *cuts.columns, F.col(f"{mark}child").alias(path), F.col(f"{mark}next").alias(column)))
    intervals = found[0]
    for more in found[1:]:
        intervals = intervals.unionByName(more)
    return Lookup(checkpointed(roots), [checkpointed(s) for s in steps], checkpointed(intervals), keys, order, mark)
