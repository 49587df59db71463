"""A tidy table of what a run was given and what it reached."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_METRICS, LOG_PARAMS

COLUMNS = ["run_id", "kind", "key", "text", "value", "step"]


def run_log(
    entries: DataFrame, prefix: str = "", history: DataFrame | None = None,
    known_params: Iterable[str] = LOG_PARAMS, known_metrics: Iterable[str] = LOG_METRICS,
) -> DataFrame:
    """Rows (run_id, kind, key, text, value, step) of the known parameters and
    metrics of each entry; missing and empty values are left out.

    ``history`` holds (run_id, metric, epoch, value) and becomes metrics with
    a step.
    """
    params = [c for c in known_params if c in entries.columns]
    metrics = [c for c in known_metrics if c in entries.columns]
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    no_step = F.lit(None).cast("int")
    parts = []
    if params:
        texts = entries.select("run_id", *[F.col(c).cast("string").alias(c) for c in params])
        parts.append(
            texts.unpivot(["run_id"], params, "key", "text")
            .filter(F.col("text").isNotNull() & (F.col("text") != ""))
            .select("run_id", F.lit("param").alias("kind"), "key", "text",
                    no_value.alias("value"), no_step.alias("step")))
    if metrics:
        values = entries.select("run_id", *[F.col(c).cast("double").alias(c) for c in metrics])
        parts.append(
            values.unpivot(["run_id"], metrics, "key", "value")
            .filter(F.col("value").isNotNull())
            .select("run_id", F.lit("metric").alias("kind"),
                    F.concat(F.lit(prefix), "key").alias("key"), no_text.alias("text"),
                    "value", no_step.alias("step")))
    if history is not None:
        named = F.concat(F.lit(prefix), "metric", F.lit("_"), F.col("epoch").cast("string"))
        parts.append(history.filter(F.col("value").isNotNull()).select(
            "run_id", F.lit("metric").alias("kind"), named.alias("key"), no_text.alias("text"),
            "value", F.col("epoch").cast("int").alias("step")))
    if not parts:
        raise ValueError("no known parameter or metric to log")
    log = parts[0]
    for part in parts[1:]:
        log = log.union(part)
    return log


def append_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
