"""The job queue: messages arrive in a folder, valid ones are run once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import DEFAULT_TUNER, JOB_MODELS

_SCHEMA = "model_name string, tuner string"


def parse_job(body: Column) -> Column:
    """A message as struct<model_name, tuner>; null fields if it is not an object."""
    return F.from_json(body, _SCHEMA)


def job_messages(df: DataFrame, body: str = "value") -> DataFrame:
    """Add ``model_name``, ``tuner`` and ``rejected`` (the reason, or null).

    Works on a stream and on a table. Text that is not JSON and JSON that is
    not an object both give an all-null struct, so the two are told apart by
    a second, lenient parse.
    """
    # 'null' where the text is JSON but no object
    document = F.try_parse_json(F.col(body))
    kind = F.schema_of_variant(document)
    job = parse_job(F.col(body))
    rejected = (
        F.when(document.isNull(), "not JSON")
        .when(~kind.startswith("OBJECT"), "not an object")
        .when(job["model_name"].isNull(), "no model_name")
        .when(~job["model_name"].isin(*JOB_MODELS), "unknown model")
    )
    return df.withColumns({
        "rejected": rejected,
        "model_name": F.when(rejected.isNull(), job["model_name"]),
        "tuner": F.when(rejected.isNull(), F.coalesce(job["tuner"], F.lit(DEFAULT_TUNER))),
    })


def valid_jobs(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("rejected").isNull()).drop("rejected")


def dead_letters(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("rejected").isNotNull()).drop("model_name", "tuner")


def read_queue(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The stream of raw messages, one line each."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def store_messages(
    stream: DataFrame, out: str, checkpoint: str, body: str = "value"
) -> StreamingQuery:
    """Sort messages into the ``jobs`` and ``dead`` tables below ``out``.

    A replayed batch overwrites its own folder, so each message is stored once.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = job_messages(batch, body).persist()
        valid_jobs(parsed).write.mode("overwrite").parquet(f"{out}/jobs/batch={batch_id}")
        dead_letters(parsed).write.mode("overwrite").parquet(f"{out}/dead/batch={batch_id}")
        parsed.unpersist()

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of finished work, empty before the first of it."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder(value: str) -> str:
    """A text as part of a partition's path."""
    return quote(value, safe="") or "__HIVE_DEFAULT_PARTITION__"


_RUNS = "batch long, model_name string, tuner string, state string, reason string"


def run_jobs(
    stream: DataFrame, run: Callable[[str, str], DataFrame], out: str, checkpoint: str,
    body: str = "value", poll: str | None = None,
) -> StreamingQuery:
    """Run every valid job, one after the other, and account for every message.

    ``run(model_name, tuner)`` is the training to do, for example
    ``plans.flows.job_runner``; its rows go to ``results`` below ``out``. Equal
    jobs of a batch are run once. Without ``poll`` the worker ends when the queue
    is empty; with it ('10 seconds') it stands and looks for new messages so often.

    ``states`` holds each message with its state: ``done``; ``failed``, with the
    error; or ``dead``, with why it is no job. The stream's checkpoint takes the
    place of an acknowledgement: a batch that was not finished comes again.
    Each job that ended is noted in ``runs`` at once, so a batch that comes
    again runs only the jobs that had not ended, and overwrites what these and
    the batch itself had stored. A failed job is not tried again.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = job_messages(batch, body).select(
            F.col(body).alias("body"), "model_name", "tuner", "rejected").persist()
        runs = _ledger(spark, f"{out}/runs", _RUNS).filter(F.col("batch") == batch_id)
        open_jobs = valid_jobs(parsed).select("model_name", "tuner").distinct().join(
            runs, ["model_name", "tuner"], "left_anti").orderBy("model_name", "tuner")
        # one after the other; the driver holds a part of the list at a time
        for name, tuner in open_jobs.toLocalIterator():
            state, reason = "done", None
            try:
                run(name, tuner).write.mode("overwrite").parquet(
                    f"{out}/results/batch={batch_id}/model={name}/tuner={_folder(tuner)}")
            except Exception as error:  # a failed job must not stop the queue
                state, reason = "failed", str(error)[:200]
            spark.createDataFrame([(batch_id, name, tuner, state, reason)], _RUNS).coalesce(
                1).write.mode("append").parquet(f"{out}/runs")
        ended = _ledger(spark, f"{out}/runs", _RUNS).filter(F.col("batch") == batch_id)
        joined = parsed.join(ended.drop("batch"), ["model_name", "tuner"], "left")
        dead = F.col("rejected").isNotNull()
        joined.select(
            "body", "model_name", "tuner",
            F.when(dead, "dead").otherwise(F.col("state")).alias("state"),
            F.when(dead, F.col("rejected")).otherwise(F.col("reason")).alias("reason"),
        ).write.mode("overwrite").parquet(f"{out}/states/batch={batch_id}")
        parsed.unpersist()

    trigger = {"availableNow": True} if poll is None else {"processingTime": poll}
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def publish_jobs(
    spark: SparkSession, folder: str, models: Iterable[str] | DataFrame = JOB_MODELS,
    tuner: str = DEFAULT_TUNER,
) -> None:
    """Empty the queue folder and put one message per model into it.

    ``models`` is a list of names or a table with the names in its first column.
    """
    if not isinstance(models, DataFrame):
        models = spark.createDataFrame([(m,) for m in models], "model_name string")
    jobs = models.select(F.col(models.columns[0]).alias("model_name"), F.lit(tuner).alias("tuner"))
    jobs.write.mode("overwrite").json(folder)
