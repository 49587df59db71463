"""Training jobs from the queue to the run log."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from buildlens.plans import flows
from buildlens.streaming import jobs as J

FEATURES = ["signal", "noise"]
SPACE = {"time_step": [6], "reg_param": [0.1], "max_iter": [20]}
ONLINE = {"top": 3, "n_folds": 2, "window": 300, "step": 60, "repeats": 2, "space": SPACE}


@pytest.fixture(scope="module")
def builds(spark):
    """Three projects where ``signal`` tells most of the next failures."""
    rows = []
    for number, project in enumerate("abc"):
        rng = random.Random(number)
        fails = [int(rng.random() < 0.4) for _ in range(421)]
        for i in range(420):
            told = fails[i + 1] if rng.random() < 0.7 else int(rng.random() < 0.4)
            rows.append((project, i * 60, i * 3, 0, fails[i], told * 2 + rng.random(), rng.random()))
    df = spark.createDataFrame(
        rows, "gh_project_name string, at long, tr_build_id long, tr_job_id long, "
        "build_failed int, signal double, noise double")
    return df.withColumn("gh_build_started_at", F.timestamp_seconds("at")).drop("at").persist()


def _states(spark, out):
    return sorted((r["state"], r["body"], r["reason"] or "") for r in
                  spark.read.parquet(f"{out}/states").collect())


def test_a_batch_that_comes_again_runs_only_what_had_not_ended(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    queue = tmp_path / "queue"
    queue.mkdir()
    bodies = ['{"model_name": "ConvLSTM", "tuner": "rs"}', '{"model_name": "ConvLSTM", "tuner": "rs"}',
              '{"model_name": "Padding"}', '{"model_name": "Stacked-LSTM", "tuner": "a/b=.."}', "[1]"]
    (queue / "a.txt").write_text("\n".join(bodies))
    calls = []

    def run(model, tuner):
        calls.append((model, tuner))
        if model == "Stacked-LSTM":
            raise ValueError("no such tuner")
        return spark.range(3)

    def drain(checkpoint):
        J.run_jobs(J.read_queue(spark, str(queue)), run, out, checkpoint).awaitTermination()

    create = SparkSession.createDataFrame

    def lost(self, data, *args, **options):
        if isinstance(data, list) and data and "Padding" in data[0]:
            raise RuntimeError("the driver went away before the job's end was noted")
        return create(self, data, *args, **options)

    with monkeypatch.context() as patched:
        patched.setattr(SparkSession, "createDataFrame", lost)
        with pytest.raises(StreamingQueryException):
            drain(f"{out}/ck")
    assert calls == [("ConvLSTM", "rs"), ("Padding", "ga")]
    drain(f"{out}/ck")
    assert calls[2:] == [("Padding", "ga"), ("Stacked-LSTM", "a/b=..")]
    states = _states(spark, out)
    assert [s for s, _, _ in states] == ["dead", "done", "done", "done", "failed"]
    assert states[0][2] == "not an object" and "no such tuner" in states[4][2]
    # the whole batch once more, as after a lost checkpoint: nothing runs, nothing doubles
    drain(f"{out}/ck2")
    assert len(calls) == 4 and _states(spark, out) == states
    assert spark.read.parquet(f"{out}/results").count() == 6


def test_a_standing_worker_sees_later_messages(spark, tmp_path):
    queue, out = tmp_path / "queue", str(tmp_path / "out")
    queue.mkdir()
    (queue / "a.txt").write_text('{"model_name": "Padding"}')
    worker = J.run_jobs(J.read_queue(spark, str(queue)), lambda m, t: spark.range(1), out,
                        f"{out}/ck", poll="100 milliseconds")
    try:
        worker.processAllAvailable()
        (queue / "b.txt").write_text('{"model_name": "ConvLSTM"}')
        worker.processAllAvailable()
        assert worker.isActive and spark.read.parquet(f"{out}/states").count() == 2
    finally:
        worker.stop()


def test_unknown_jobs_are_errors_before_any_work(spark):
    with pytest.raises(ValueError):
        flows.train(None, "Transformer")
    with pytest.raises(ValueError):
        flows.train(None, "ConvLSTM", "tpe")


def test_both_phases_are_summarised_and_logged(spark, builds):
    found = flows.validate(builds, FEATURES, "random", "ConvLSTM", online=ONLINE,
                           cross={"space": SPACE, "repeats": 2})
    summary = {r["phase"]: r["entries"] for r in found.summary.collect()}
    online, crossed = found.online.entries.collect(), found.cross.entries.collect()
    assert summary == {"online": len(online), "cross_project": len(crossed),
                       "overall": len(online) + len(crossed)}
    assert len(found.cross.training) == 2
    log = found.log.collect()
    runs = {r["run_id"] for r in log}
    assert len(runs) == summary["overall"]
    logged = {(r["run_id"], r["key"]): r["text"] or r["value"] for r in log}
    for e in online:
        run = f"ConvLSTM/online/{e['proj']}/{e['exp']}/{e['iter']}"
        assert logged[run, "time_step"] == "6" and logged[run, "F1"] == e["F1"]
        assert logged[run, "project"] == e["proj"] and logged[run, "validation_loss"] > 0
    for e in crossed:
        assert logged[f"ConvLSTM/cross_project/{e['proj']}/1/1", "AUC"] == e["AUC"]


def test_models_fitted_again_for_each_project(spark, builds):
    params = {"time_step": 4, "reg_param": 0.1, "max_iter": 5}
    found = flows.validate(builds, FEATURES, "random", online=ONLINE,
                           adapted={"params": params, "top": 2})
    assert found.cross is None
    phases = {r["phase"]: r["entries"] for r in found.summary.collect()}
    assert phases["adapted"] == found.adapted.count() and found.bellwether not in {
        r["proj"] for r in found.adapted.collect()}


def test_border_jobs_log_their_scores(spark, builds):
    log = {r["key"]: r["text"] or r["value"] for r in flows.train(
        builds, "Padding", features=FEATURES, border={"length": 6}).collect()}
    assert log["algo"] == "Padding" and log["time_step"] == "6" and log["R2"] > 0.9
