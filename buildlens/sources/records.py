"""CSV records whose quoted fields hold line breaks, read in parallel within a file.

A line may begin outside or inside a quoted field. Which of both follows from all
lines before it, in other splits too. So every split is read for both cases:

1. Each line gets its number in the split, the line at which its record begins and
   whether a field is open after it, for either case. The lines are stored once.
2. A split's last line says how it turns the case it begins with into the case it
   ends with. Running over the splits of a file (one small row each) tells which
   case each split begins with, and where the record began that it continues.
3. Records of one line need no shuffle. Only lines of longer records are gathered.

A quote opens a field at the field's start only, and is doubled inside it. A quote that
never closes opens nothing: its line and the file's later lines are read one by one.
Lines end with a line feed, with or without a carriage return. Blank records are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

_QUOTED = r'(?:[^"]|"")*+"[^,]*+'
_FIELD = rf'(?:"{_QUOTED}|(?!")[^,]*+)'
#: Lines after which no field is open, if none was open before, or if one was.
CLOSED, CLOSING = rf"{_FIELD}(?:,{_FIELD})*+", rf"{_QUOTED}(?:,{_FIELD})*+"


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, value): all lines, and where in its file the split starts."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def opens_a_field(line: Column) -> Column:
    return F.contains(line, F.lit('"')) & ~F.rlike(line, F.lit(rf"(?s)^{CLOSED}\z"))


def paths_with_breaks(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those files of which some line ends inside a field; all others can be read line by line."""
    found = lines_of(spark, paths).filter(opens_a_field(F.col("value"))).select("path").distinct()
    # a part of the listing the driver has already
    return {r["path"] for r in found.toLocalIterator()}


_LINES = ("path string, block long, line long, value string, out_start long, out_open boolean, "
          "in_start long, in_open boolean")


def _annotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number a split's lines; for both cases, where the record begins and whether a field is open.

    ``in_start`` is -1 while the record goes on that an earlier split began.
    """
    closed, closing = re.compile(CLOSED, re.DOTALL), re.compile(CLOSING, re.DOTALL)
    split, line, starts, is_open = None, 0, [0, -1], [False, True]
    for batch in batches:
        rows = []
        for path, block, value in batch.itertuples(index=False):
            if split != (path, block):
                split, line, starts, is_open = (path, block), 0, [0, -1], [False, True]
            quotes = '"' in value
            for case in (0, 1):
                if not is_open[case]:
                    starts[case] = line
                if quotes:
                    is_open[case] = not (closing if is_open[case] else closed).fullmatch(value)
            rows.append((path, block, line, value, starts[0], is_open[0], starts[1], is_open[1]))
            line += 1
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LINES.split(", ")])


_SPLITS = ("path string, block long, inside boolean, from_block long, from_line long, "
           "lost_block long, lost_line long")


def _run_over_splits(splits: pd.DataFrame) -> pd.DataFrame:
    """The case each split of one file begins with, and the record that never ends, if any."""
    inside, began, rows = False, (None, None), []
    for s in splits.sort_values("block").itertuples():
        rows.append([s.path, s.block, inside, *(began if inside else (None, None))])
        start, is_open = (s.in_start, s.in_open) if inside else (s.out_start, s.out_open)
        if start >= 0:
            began = (s.block, start)
        inside = is_open
    lost = began if inside else (None, None)
    return pd.DataFrame([[*r, *lost] for r in rows], columns=[
        c.split()[0] for c in _SPLITS.split(", ")]).astype(
        {c: "Int64" for c in ("from_block", "from_line", "lost_block", "lost_line")})


def records_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, line, record): the records of files, with where each begins."""
    lines = stored(lines_of(spark, paths).mapInPandas(_annotate, _LINES), "csv-lines")
    last = F.max_by(F.struct("out_start", "out_open", "in_start", "in_open"), "line").alias("last")
    splits = lines.groupBy("path", "block").agg(last).select("path", "block", "last.*")
    cases = splits.groupBy("path").applyInPandas(_run_over_splits, _SPLITS)
    own = F.when(F.col("inside"), F.col("in_start")).otherwise(F.col("out_start"))
    here = own >= 0
    is_open = F.when(F.col("inside"), F.col("in_open")).otherwise(F.col("out_open"))
    placed = lines.join(cases, ["path", "block"]).select(
        "path", "block", "line", "value", is_open.alias("open"), "lost_block", "lost_line",
        F.when(here, F.col("block")).otherwise(F.col("from_block")).alias("start_block"),
        F.when(here, own).otherwise(F.col("from_line")).alias("start_line"))
    begins = (F.col("start_block") == F.col("block")) & (F.col("start_line") == F.col("line"))
    lost = F.coalesce((F.col("start_block") == F.col("lost_block"))
                      & (F.col("start_line") == F.col("lost_line")), F.lit(False))
    alone = lost | (begins & ~F.col("open"))
    # the lines of one record
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    longer = placed.filter(~alone).groupBy("path", "start_block", "start_line").agg(
        F.array_join(parts["value"], "\n").alias("record"))
    records = placed.filter(alone).select("path", "block", "line", F.col("value").alias("record")).union(
        longer.select("path", "start_block", "start_line", "record"))
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record <> ''")
