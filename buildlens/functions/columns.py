"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: status words and boolean spellings of the build logs
PASSED = ["passed"]
FAILED = ["failed", "errored"]
TRUE_TEXT = ["True", "1.0"]
FALSE_TEXT = ["False", "0.0"]


def label_of_status(status: Column, kind: T.DataType) -> Column:
    """0 for passed, 1 for failed or errored, null otherwise; 0/1 numbers stay."""
    if isinstance(kind, T.NumericType):
        return F.when(status.isin(0, 1), status.cast("int"))
    return F.when(status.isin(*PASSED), F.lit(0)).when(status.isin(*FAILED), F.lit(1))


def bool_text(value: Column) -> Column:
    """Mixed spellings of a flag as 1.0 / 0.0; other text is parsed as a number."""
    return (
        F.when(value.isin(*TRUE_TEXT), F.lit(1.0))
        .when(value.isin(*FALSE_TEXT), F.lit(0.0))
        .otherwise(value.try_cast("double"))
    )


def number(value: Column) -> Column:
    """Text as a double, null where it is not a number (NaN counts as null)."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def calendar_parts(at: Column) -> dict[str, Column]:
    return {
        "year_of_start": F.year(at),
        "month_of_start": F.month(at),
        "day_of_start": F.dayofmonth(at),
        "hour_of_start": F.hour(at),
    }


def day_week(at: Column) -> Column:
    """Monday is 0."""
    return F.weekday(at)


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = value.cast("double") * F.lit(2 * pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def safe_name(value: Column) -> Column:
    """A name usable as a file name."""
    return F.translate(value, "/\\", "__")


def parse_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals, halves to even."""
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), 2)


def ratio4(value: Column) -> Column:
    return F.bround(value, 4)


def edited_files(added: Column, deleted: Column, modified: Column) -> Column:
    """Number of files touched; a missing part counts as none."""
    parts = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (added, deleted, modified)]
    return reduce(lambda a, b: a + b, parts)


def config_flag(doc_files: Column) -> Column:
    """1 when documentation files changed. The column name says the opposite;
    the meaning is kept so that results stay comparable."""
    return F.coalesce(doc_files > 0, F.lit(False)).cast("int")


def to_label(probability: Column, threshold) -> Column:
    bound = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (probability >= bound).cast("int")


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where it is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def only_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct, usable in another frame.

    A scalar subquery: it is run once and its value handed to every task, so
    nothing is joined.
    """
    return df.select(F.struct(*df.columns)).scalar()
