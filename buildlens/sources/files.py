"""CSV job files in several header dialects, and per-project tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.profile import union_all_by_name
from ..schema import CANONICAL, LABEL, PROJECT, STARTED, TIME_ORDER, match_dialect, source_name
from ..session import checkpointed, stored
from . import records

# fixed values: words that other writers of CSV leave for a missing text
MISSING_WORDS = ["", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None"]
_HEADER_BYTES = 1 << 20
_MAX_HEADERS = 1_000


# -- listing and headers ------------------------------------------------------
def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, folder, file) of every matching file; contents are not read.

    The names come from Spark's own (parallel) listing. A scan would leave out
    files of length 0, which have to be reported.
    """
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(folder).inputFiles()
    )
    names = [(unquote(path),) for path in found]
    listed = spark.createDataFrame(names, "path string").repartition(
        min(max(len(names) // 8, 1), 1_000))
    parts = F.split("path", "/")
    return listed.select(
        "path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"))


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read only the beginning of each file, in the task that holds its path."""
    from pyarrow import fs

    for batch in batches:
        headers, errors = [], []
        for path in batch["path"]:
            scheme, _, rest = path.partition(":")
            # file:/x and file:///x name the same file
            uri = f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest)}"
            try:
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(inner) as stream:
                    text = stream.read(_HEADER_BYTES).decode("utf-8-sig", "replace")
                line = next(csv.reader(text.splitlines()[:1]), None)
                headers.append(line)
                errors.append(None if line else "no header")
            except OSError as error:
                headers.append(None)
                errors.append(str(error))
        yield batch.assign(header=headers, error=errors)


def file_headers(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, folder, file, header, error): one row per file, header null if unreadable."""
    schema = "path string, folder string, file string, header array<string>, error string"
    return list_files(spark, folder, glob).mapInPandas(_first_lines, schema)


def schema_groups(headers: DataFrame) -> DataFrame:
    """Files by exact ordered header: one row per file with its group's size."""
    readable = headers.filter(F.col("header").isNotNull())
    sizes = readable.groupBy("header").agg(F.count(F.lit(1)).alias("files"))
    return readable.join(sizes, "header").select(
        F.array_join("header", ",").alias("header"), "files", "folder", "file")


def _paths_by_header(headers: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Paths per header, as the reader needs them (a file listing, not data)."""
    readable = headers.filter(F.col("header").isNotNull())
    kinds = readable.select("header").distinct().limit(_MAX_HEADERS + 1).count()
    if kinds > _MAX_HEADERS:
        raise ValueError(f"more than {_MAX_HEADERS} different headers")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in readable.select("header", "path").orderBy("path").toLocalIterator():
        groups.setdefault(tuple(row["header"]), []).append(row["path"])
    return groups


CORRUPT = "_corrupt_record"


def _read_text(
    spark: SparkSession, header: Iterable[str], paths: list[str], corrupt: bool = False
) -> DataFrame:
    """Files of one header with every column as text, and where rows come from.

    Fields may hold line breaks. Files of which every line is a record are read by
    Spark's reader, the others by ``records``, in parallel too. ``corrupt`` adds the
    text of records with too many or too few fields.
    """
    header = list(header)
    names = [*header, CORRUPT] if corrupt else header
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    # quotes inside quoted fields are doubled
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": CORRUPT}
    # metadata holds escaped paths, the listing plain ones
    plain, parts, frames = F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B"))), F.split("_path", "/"), []
    found = {_spelling(unquote(path)) for path in records.paths_with_breaks(spark, paths)}
    whole = [p for p in paths if _spelling(p) not in found]
    broken = [p for p in paths if _spelling(p) in found]
    if whole:
        read = spark.read.schema(schema).options(header="true", **options).csv(whole)
        frames.append(read.select(*names, F.col("_metadata.file_path").alias("_path")))
    if broken:
        rows = records.records_of(spark, broken)
        # a file's first record is its header
        rows = rows.filter((F.col("block") > 0) | (F.col("line") > 0)).select(
            F.from_csv("record", schema.toDDL(), options).alias("_row"), F.col("path").alias("_path"))
        frames.append(rows.select("_row.*", "_path"))
    return union_all_by_name(*frames).withColumn("_path", plain).select(
        *names, "_path", F.element_at(parts, -2).alias("_folder"), F.element_at(parts, -1).alias("_file"))


def _spelling(path: str) -> str:
    """file:/x and file:///x name the same file."""
    return re.sub(":/+", ":/", path, count=1)


def _one_spelling(path: str) -> Column:
    return F.regexp_replace(path, "^([^/]*):/+", "$1:/").alias("_at")


def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, file, rows, malformed, longest): a file's records, how many have too many or
    too few fields, and the most characters of one."""
    counted = [
        _read_text(spark, header, paths, corrupt=True).groupBy("_folder", "_file").agg(
            F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("malformed"),
            F.max(F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in header]))).alias("longest"))
        for header, paths in _paths_by_header(file_headers(spark, folder)).items()]
    if not counted:
        raise FileNotFoundError(f"no readable CSV file in {folder}")
    # one row a file; the reader gives malformed records only along with other columns
    return checkpointed(union_all_by_name(*counted).withColumnsRenamed(
        {"_folder": "folder", "_file": "file"}))


def _typed(column: str) -> Column:
    kind = CANONICAL.get(column)
    text = F.col(column)
    if kind is None:
        # a derived feature
        return C.number(text) if column != LABEL else C.number(text).cast("int")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(text.try_cast("boolean"), C.bool_text(text) == 1.0)
    if isinstance(kind, T.TimestampType):
        return C.parse_timestamp(text)
    if isinstance(kind, T.StringType):
        return F.when(~F.trim(text).isin(MISSING_WORDS), text)
    if isinstance(kind, T.DoubleType):
        return C.number(text)
    # whole numbers may be written with a zero fraction, as where some are missing
    exact = text.try_cast("decimal(38,9)")
    return F.when(exact == F.floor(exact), exact.try_cast(kind))


# -- scans --------------------------------------------------------------------
def scan_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """One header's files with known columns typed; bad numbers become null."""
    groups = _paths_by_header(file_headers(spark, path))
    if not groups:
        raise FileNotFoundError(f"no readable CSV file in {path}")
    frames = [
        _read_text(spark, header, paths).select(*[
            (_typed(c) if c in CANONICAL else F.col(c)).alias(c) for c in header])
        for header, paths in groups.items()
    ]
    return union_all_by_name(*frames)


def scan_project_dir(
    spark: SparkSession, folder: str, file_list: Iterable[str] | None = None,
    required: str = LABEL,
) -> tuple[DataFrame, DataFrame]:
    """(rows of all accepted files, rejected files with a reason).

    Files are accepted if their header holds the label. No file listed, or
    none accepted, is an error.
    """
    headers = file_headers(spark, folder)
    if file_list is not None:
        names = list(file_list)
        headers = headers.filter(F.col("file").isin(names) | F.col("folder").isin(names))
    if headers.isEmpty():
        raise ValueError(f"no CSV files found in {folder}")
    has = F.coalesce(F.array_contains("header", required), F.lit(False))
    groups = _paths_by_header(headers.filter(has))
    if not groups:
        raise RuntimeError(f"no data loaded from {folder}")
    frames = [
        _read_text(spark, header, paths).select(
            "_folder", "_file", *[_typed(c).alias(c) for c in header])
        for header, paths in groups.items()
    ]
    reason = F.coalesce("error", F.lit(f"column {required} not found"))
    rejected = headers.filter(~has).select("folder", "file", reason.alias("reason"))
    return union_all_by_name(*frames), rejected


def scan_time_series(spark: SparkSession, path: str) -> DataFrame:
    """One project's table in time order; a missing table is an error."""
    try:
        rows, _ = scan_project_dir(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"{path} not found") from error
    return rows.drop("_folder", "_file").orderBy(*[c for c in TIME_ORDER if c in rows.columns])


def file_inventory(
    spark: SparkSession, folder: str, label: str = LABEL
) -> tuple[DataFrame, DataFrame]:
    """(per file: rows and class percents, largest first; one-row total).

    Percents are null without a label column, rows are null if unreadable.
    """
    headers = file_headers(spark, folder)
    counts = []
    for header, paths in _paths_by_header(headers).items():
        rows = _read_text(spark, header, paths)
        y = C.number(F.col(label)) if label in header else F.lit(None).cast("double")
        counts.append(rows.groupBy(_one_spelling("_path"))
                      .agg(F.count(F.lit(1)).alias("rows"), F.count(y).alias("_known"),
                           F.count_if(y == 0).alias("_zero"), F.count_if(y == 1).alias("_one")))
    # different folders may have equal names
    files = headers.select(_one_spelling("path"), "folder", "file", F.col("header").isNotNull().alias("_readable"),
                           F.array_contains("header", label).alias("_labelled"))
    if counts:
        files = files.join(union_all_by_name(*counts), "_at", "left")
    else:
        files = files.withColumns({
            n: F.lit(None).cast("long") for n in ("rows", "_known", "_zero", "_one")})

    def percent(part: str) -> Column:
        share = F.coalesce(C.percent(F.col(part), F.col("_known")), F.lit(0.0))
        return F.when(F.col("_labelled"), share)

    inventory = files.select(
        "folder", "file",
        F.when(F.col("_readable"), F.coalesce("rows", F.lit(0))).alias("rows"),
        percent("_zero").alias("pct_0"), percent("_one").alias("pct_1"),
    ).orderBy(F.desc_nulls_last("rows"), "folder", "file")
    total = inventory.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))
    return inventory, total


# -- canonical table ----------------------------------------------------------
def canonicalise(df: DataFrame, dialect: str) -> DataFrame:
    """Rename a dialect to canonical names and types, in canonical order."""
    renamed = {
        c: source_name(dialect, c) for c in CANONICAL if source_name(dialect, c) in df.columns}
    named = df.select(*[F.col(source).alias(c) for c, source in renamed.items()])
    return named.select(*[_typed(c).alias(c) for c in renamed])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value (one pass over the data)."""
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if seen[c]])


def combine_sources(spark: SparkSession, folder: str, out: str) -> DataFrame | None:
    """Every file of every dialect as one canonical table written to ``out``.

    A dialect is recognised by header names. Files without any known column
    are left out; without a usable file nothing is written.
    """
    frames = []
    for header, paths in _paths_by_header(file_headers(spark, folder)).items():
        dialect = match_dialect(list(header))
        if dialect is not None:
            frames.append(canonicalise(_read_text(spark, header, paths), dialect))
    if not frames:
        return None
    combined = union_all_by_name(*frames)
    combined = combined.select(*[c for c in CANONICAL if c in combined.columns])
    combined.write.mode("overwrite").parquet(out)
    # a null check only touches column chunks of a columnar file
    table = spark.read.parquet(out)
    kept = drop_null_columns(table)
    if kept.columns and len(kept.columns) < len(table.columns):
        stored(kept, "combined").write.mode("overwrite").parquet(out)
        kept = spark.read.parquet(out)
    return kept if kept.columns else None


def write_dialect(df: DataFrame, dialect: str, path: str) -> None:
    """Write canonical rows as CSV with the header of a dialect."""
    named = df.select(*[
        (F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == STARTED else F.col(c))
        .alias(source_name(dialect, c)) for c in df.columns])
    named.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def save_projects(df: DataFrame, out: str, project: str = PROJECT) -> DataFrame:
    """One folder of CSV files per project; (project, path).

    The rebalance hint keeps a small project in one file and splits a large
    one over several tasks.
    """
    named = df.filter(F.col(project).isNotNull()).withColumn(
        "safe_name", C.safe_name(F.col(project)))
    if STARTED in df.columns:
        named = named.withColumn(STARTED, F.date_format(STARTED, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    (
        named.hint("rebalance", "safe_name")
        .write.mode("overwrite").partitionBy("safe_name").options(header="true", quote='"', escape='"').csv(out)
    )
    names = named.select(F.col(project).alias("project"), "safe_name").distinct()
    return names.select(
        "project", F.concat(F.lit(f"{out}/safe_name="), F.col("safe_name")).alias("path"))
