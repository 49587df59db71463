"""End-to-end flows: raw files -> job table -> project tables -> validated model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import encode as N
from ..operators import history as H
from ..operators import importance as I
from ..operators import modeling as M
from ..operators import prepare as P
from ..operators import profile as A
from ..operators import rank as R
from ..schema import COMMITTER, DEFAULT_TUNER, JOB_MODELS, PERIODS, SCALED
from ..session import checkpointed
from ..sources import files, runlog
from ..streaming import jobs as J

#: Tells the label away, so it is left out of the features.
LEAKY = "tr_log_num_tests_failed"


def clean_jobs(
    jobs: DataFrame, min_rows: int = 50_000, balance: float = 0.7, top: int = 10
) -> DataFrame:
    """Finished jobs of the largest balanced projects, without missing values."""
    typed = P.normalise_bool_text(jobs, COMMITTER)
    if LEAKY in typed.columns:
        typed = typed.withColumn(LEAKY, C.number(F.col(LEAKY).cast("string")))
    finished = P.filter_status(typed)
    labelled = finished.drop("tr_status")
    chosen = R.select_projects(labelled, A.project_summary(labelled, min_rows, balance), top)
    return P.impute(chosen)


def build_table(
    jobs: DataFrame, cyclical: tuple[str, ...] = (), categorical: tuple[str, ...] = (), **selection
) -> DataFrame:
    """One scaled row per build with all features.

    The cleaned jobs are written to the checkpoint folder once: the ordered
    features read them several times, and a lost executor does not repeat
    the imputation.
    """
    cleaned = checkpointed(clean_jobs(jobs, **selection))
    builds = A.distinct_rows(A.jobs_to_builds(H.add_build_features(cleaned)))
    if categorical:
        builds, _ = N.label_encode(builds, categorical)
    builds = N.cyclical_encode(builds, cyclical, PERIODS)
    scaled, _ = N.minmax_scale(builds, SCALED)
    return scaled.drop(LEAKY)


def rank_and_save(
    builds: DataFrame, out: str, threshold: float = 0.005, trees: int = 100
) -> tuple[DataFrame, list[str], DataFrame]:
    """(importance table, dropped features, saved projects).

    The three models read the table many times, so it is materialised first.
    """
    builds = checkpointed(builds)
    _, features, _ = P.select_numeric_features(builds)
    features = [f for f in features if f != "tr_build_id"]
    importance = I.aggregate_importance(builds, features, trees=trees)
    kept, dropped = P.drop_low_importance(builds, importance, threshold)
    return importance, dropped, files.save_projects(kept, out)


def combine_and_prepare(
    spark: SparkSession, folder: str, combined: str, out: str, **selection
) -> tuple[DataFrame, list[str], DataFrame]:
    """From CSV files in any dialect to one folder of features per project."""
    jobs = files.combine_sources(spark, folder, combined)
    if jobs is None:
        raise ValueError(f"no usable file in {folder}")
    return rank_and_save(build_table(jobs, **selection), out)


#: Phases of a training job.
ONLINE, CROSS, ADAPTED, BORDER = "online", "cross_project", "adapted", "border"
#: The job that reconstructs borders; a goal of its own, by R2.
PADDING, BORDER_GOAL = "Padding", 0.7


@dataclass
class Validation:
    """The phases of a validation, their summary (each phase, and overall) and their run log.

    ``cross`` is the bellwether's model on the other projects, ``adapted`` the entries
    of models that were fitted again for each; only one of them is made.
    """

    online: M.OnlineResult
    bellwether: str
    cross: M.CrossResult | None
    adapted: DataFrame | None
    summary: DataFrame
    log: DataFrame


def _inputs(builds: DataFrame, features: list[str] | None) -> tuple[DataFrame, list[str]]:
    if features is None:
        _, features, _ = P.select_numeric_features(builds, include_label=True)
        features = [f for f in features if f not in ("tr_build_id", "tr_job_id")]
    if "tr_job_id" not in builds.columns:
        builds = builds.withColumn("tr_job_id", F.lit(0).cast("long"))
    return builds, features


def _log_entries(entries: DataFrame, model_name: str, phase: str) -> DataFrame:
    """Entries under the names of the run log."""
    return entries.withColumn("algo", F.lit(model_name)).withColumns({
        "run_id": F.concat_ws("/", F.lit(model_name), F.lit(phase), "proj", "exp", "iter"),
        "project": F.col("proj"), "fold": F.col("exp"), "iteration": F.col("iter"),
    }).drop("proj", "exp", "iter")


def validate(
    builds: DataFrame, features: list[str] | None = None, strategy: str = "ga",
    model_name: str = "Stacked-LSTM", online: dict | None = None, cross: dict | None = None,
    adapted: dict | None = None,
) -> Validation:
    """Find the bellwether project on sliding folds and try its model on the others.

    ``online`` and ``cross`` are options of the two phases. With ``adapted`` (options,
    may be empty) the second phase fits a model for each other project instead.
    """
    builds, features = _inputs(builds, features)
    found = M.online_validation(builds, features, strategy, model_name, **(online or {}))
    best = found.bellwether.first()
    if best is None:
        raise ValueError("no valid model found in online validation")
    keys = ["proj", "exp", "iter"]
    chosen = found.chosen.drop("candidate").withColumnRenamed("loss", "validation_loss")
    first = found.entries.join(F.broadcast(chosen), keys)  # as many rows as folds and repeats
    crossed, refitted = None, None
    if adapted is None:
        crossed = M.cross_project_validation(
            builds, best["proj"], features, strategy, model_name, **(cross or {}))
        phase, second = CROSS, checkpointed(crossed.entries)
        # no model, no entries: every model of the bellwether was refused
        length = crossed.model and crossed.model.length
        logged = second.withColumn("time_step", F.lit(length).cast("int"))
    else:
        refitted, _ = M.adapted_validation(builds, best["proj"], features, **adapted)
        phase, second, logged = ADAPTED, refitted, refitted
    both = found.entries.withColumn("phase", F.lit(ONLINE)).unionByName(
        second.withColumn("phase", F.lit(phase)), allowMissingColumns=True)
    log = runlog.run_log(A.union_all_by_name(
        _log_entries(first, model_name, ONLINE), _log_entries(logged, model_name, phase)))
    return Validation(found, best["proj"], crossed, refitted, A.phase_summary(both), log)


def train(
    builds: DataFrame, model_name: str = "Stacked-LSTM", tuner: str = DEFAULT_TUNER,
    features: list[str] | None = None, border: dict | None = None, **phases: dict | None,
) -> DataFrame:
    """The run log of one training job.

    ``Padding`` reconstructs borders (``border`` are its options), every other model is
    validated in two phases (``phases`` are the options of ``validate``). Unknown
    models and tuners are errors before any work.
    """
    if model_name not in JOB_MODELS:
        raise ValueError(f"unknown model {model_name!r}")
    if model_name != PADDING:
        M.check_strategy(tuner)
        return validate(builds, features, tuner, model_name, **phases).log
    builds, features = _inputs(builds, features)
    options = {"length": 40, "r2_goal": BORDER_GOAL, **(border or {})}
    card, zeroed = M.border_reconstruction(builds, features, **options)
    entry = card.select(
        F.lit(f"{model_name}/{BORDER}").alias("run_id"), F.lit(model_name).alias("algo"),
        F.lit(options["length"]).alias("time_step"), F.lit(",".join(zeroed)).alias("zeroed"), "*")
    return runlog.run_log(
        entry, known_params=["algo", "time_step", "zeroed"], known_metrics=card.columns)


def job_runner(builds: DataFrame, **options) -> Callable[[str, str], DataFrame]:
    """What ``streaming.jobs.run_jobs`` calls for each job: ``train`` on these builds."""
    return lambda model_name, tuner: train(builds, model_name, tuner, **options)


def work(
    spark: SparkSession, queue: str, builds: DataFrame, out: str, poll: str | None = None,
    files_per_batch: int = 1, **options
) -> StreamingQuery:
    """Train what the queue folder asks for. Run logs go to ``out/results``, the state of
    every message to ``out/states``; without ``poll`` the worker ends with the queue."""
    stream = J.read_queue(spark, queue, files_per_batch)
    return J.run_jobs(
        stream, job_runner(checkpointed(builds), **options), out, f"{out}/checkpoint", poll=poll)
