"""Search, validation and streaming behaviour."""

import json
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import modeling as M
from buildlens.operators import importance as I
from buildlens.operators import sequences as S
from buildlens.sources import files
from buildlens.streaming import jobs as J

SPACE = {"time_step": [3, 5], "reg_param": [0.0, 0.01], "max_iter": [40]}


@pytest.fixture(scope="module")
def separable(spark):
    """Three projects where a large ``signal`` announces that the next build fails."""
    n = 420
    noise = F.pmod(F.xxhash64("id", "project"), F.lit(1000)) / 1000
    fails = F.pmod(F.xxhash64("id", "project", F.lit(1)), F.lit(10)) < 4
    base = spark.range(n).crossJoin(
        spark.createDataFrame([("a",), ("b",), ("c",)], "project string"))
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy("id")
    rows = base.withColumn("_y", fails.cast("int")).withColumn("_n", noise)
    return rows.select(
        F.col("project").alias("gh_project_name"),
        F.timestamp_seconds(F.col("id") * 60).alias("gh_build_started_at"),
        (F.col("id") * 3).alias("tr_build_id"), F.lit(0).cast("long").alias("tr_job_id"),
        F.col("_y").alias("build_failed"), F.lit(1.0).alias("gh_by_core_team_member"),
        (F.coalesce(F.lead("_y").over(w), F.lit(0)) * 2 + F.col("_n")).alias("signal"),
        F.col("_n").alias("noise")).persist()


FEATURES = ["signal", "noise"]


def test_genetic_settings_are_checked():
    assert M.check_genetic({})["population_size"] == 2
    for bad in ({"population_size": 0}, {"max_generations": 1.5}, {"retain": 0},
                {"random_select": 2}, {"mutate_chance": -1}):
        with pytest.raises(ValueError):
            M.check_genetic(bad)


def test_next_generation_keeps_size_and_best():
    rng = random.Random(1)
    people = [M.Candidate(("p", 1, 1), i, M.draw(SPACE, rng), score=i / 10) for i in range(1, 7)]
    nxt = M.next_generation(people, SPACE, M.check_genetic({}), rng)
    assert len(nxt) == 6 and nxt[0] is people[-1]
    assert len({c.number for c in nxt}) == 6
    assert all(c.params[k] in SPACE[k] for c in nxt for k in SPACE)


def test_survivors_are_not_fitted_again():
    seen = []

    def evaluate(candidates):
        for c in candidates:
            seen.append((c.group, c.number))
            c.score, c.loss = 0.5 + c.number / 100, 1.0

    tried = M.search(evaluate, [("p", 1, 1), ("q", 1, 1)], "ga", SPACE)
    assert len(seen) == len(set(seen)) == len(tried)
    with pytest.raises(ValueError):
        M.search(evaluate, [("p", 1, 1)], "tpe", SPACE)


def test_online_validation_finds_the_signal(separable):
    options = dict(top=3, n_folds=2, window=300, step=60, repeats=1, space=SPACE)
    result = M.online_validation(separable, FEATURES, "random", threshold_from="test", **options)
    auc = [r["AUC"] for r in result.candidates.sparkSession.createDataFrame(
        result.entries.collect(), result.entries.schema).collect()]
    tried = result.candidates.collect()
    assert 3 * 2 <= len(tried) <= 3 * 2 * M.EVALUATIONS
    assert min(c["score"] for c in tried) > 0.9
    # separable on purpose, so the gate may drop entries; what is left is good
    assert all(a > 0.9 for a in auc)
    again = M.online_validation(separable.repartition(7), FEATURES, "random",
                                threshold_from="test", **options)
    key = lambda c: (c["proj"], c["exp"], c["candidate"])
    assert [c["score"] for c in sorted(again.candidates.collect(), key=key)] == pytest.approx(
        [c["score"] for c in sorted(tried, key=key)], abs=0.05)


def test_cross_project_uses_the_bellwether_context(separable):
    source = separable.filter("gh_project_name = 'a'")
    windows = M.target_windows(separable, source, FEATURES, 4)
    assert windows.count() == 840
    first = windows.filter("gh_project_name = 'b' AND tr_build_id = 0").first()["window"]
    tail = [[r["signal"], r["noise"]] for r in
            source.orderBy(F.desc("tr_build_id")).limit(4).collect()][::-1]
    assert first == tail
    params = {"time_step": 4, "reg_param": 0.01, "max_iter": 30}
    model = M.fit_window_classifier(S.train_windows(source, FEATURES, 4), FEATURES, params)
    scored = M.score_windows(model, windows).select(
        F.col("gh_project_name").alias("proj"), F.lit(1).alias("exp"), F.lit(1).alias("iter"),
        "y", "p")
    entries = M.fixed_threshold_entries(scored, model.threshold).collect()
    assert {e["proj"] for e in entries} == {"b", "c"}
    assert all(e["AUC"] > 0.95 and e["threshold"] == model.threshold for e in entries)


def test_border_reconstruction_is_exact_for_a_linear_map(separable):
    card, zeroed = M.border_reconstruction(separable, FEATURES, 8, max_samples=600)
    assert card.first()["R2"] > 0.99 and zeroed == []


def test_importance_ranks_the_signal_first(separable):
    lagged = separable.withColumn("hint", F.col("build_failed") + F.col("noise") / 4)
    table = I.aggregate_importance(lagged, ["hint", "noise"], trees=5, max_iter=30).collect()
    assert table[0]["Feature"] == "hint" and table[0]["Average_Importance"] > 0.9


# -- queue --------------------------------------------------------------------
BODIES = [
    '{"model_name": "ConvLSTM", "tuner": "rs"}', '{"model_name": "Padding"}', '{"tuner": "ga"}',
    '{"model_name": "Other"}', "[1]", "not json", "", '{"model_name": "Stacked-LSTM", "tuner": "x"}',
]


def test_messages(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "value string")
    got = {r["value"]: (r["rejected"], r["model_name"], r["tuner"]) for r in
           J.job_messages(df).collect()}
    assert got[BODIES[0]] == (None, "ConvLSTM", "rs")
    assert got[BODIES[1]] == (None, "Padding", "ga")
    assert [got[b][0] for b in BODIES[2:7]] == [
        "no model_name", "unknown model", "not an object", "not JSON", "not JSON"]


def test_jobs_run_once_and_failures_do_not_stop_the_queue(spark, tmp_path):
    queue, out = tmp_path / "queue", str(tmp_path / "out")
    queue.mkdir()
    (queue / "a.txt").write_text("\n".join(BODIES))
    calls = []

    def run(model, tuner):
        calls.append((model, tuner))
        if tuner == "x":
            raise ValueError("no such tuner")
        return spark.range(1)

    def drain():
        J.run_jobs(J.read_queue(spark, str(queue)), run, out, f"{out}/ck").awaitTermination()

    drain()
    assert sorted(calls) == [("ConvLSTM", "rs"), ("Padding", "ga"), ("Stacked-LSTM", "x")]
    states = {r["model_name"]: r["state"] for r in spark.read.parquet(f"{out}/states").collect()}
    assert states["ConvLSTM"] == "done" and states["Stacked-LSTM"].startswith("failed")
    drain()  # same checkpoint: nothing new
    assert len(calls) == 3
    (queue / "b.txt").write_text('{"model_name": "ConvLSTM", "tuner": "rs"}')
    drain()
    assert len(calls) == 4


def test_publish_replaces_the_queue(spark, tmp_path):
    folder = str(tmp_path / "queue")
    J.publish_jobs(spark, folder, ["A"])
    J.publish_jobs(spark, folder)
    bodies = [json.loads(r["value"]) for r in spark.read.text(folder).collect()]
    assert sorted(b["model_name"] for b in bodies) == [
        "ConvLSTM", "Padding", "Stacked-BiLSTM", "Stacked-LSTM"]
    assert {b["tuner"] for b in bodies} == {"ga"}


# -- files --------------------------------------------------------------------
def test_rejected_and_empty_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("build_failed,gh_sloc\n1,5\n0,x\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("build_failed,gh_sloc\n")
    rows, rejected = files.scan_project_dir(spark, str(tmp_path))
    assert sorted((r["build_failed"], r["gh_sloc"]) for r in rows.collect()
                  if r["gh_sloc"]) == [(1, 5.0)]
    assert {r["file"]: r["reason"] for r in rejected.collect()} == {
        "other.csv": "column build_failed not found", "empty.csv": "no header"}
    inventory, total = files.file_inventory(spark, str(tmp_path))
    got = {r["file"]: (r["rows"], r["pct_0"], r["pct_1"]) for r in inventory.collect()}
    assert got == {"good.csv": (2, 50.0, 50.0), "other.csv": (1, None, None),
                   "bare.csv": (0, 0.0, 0.0), "empty.csv": (None, None, None)}
    assert total.first()[0] == 3
    with pytest.raises(RuntimeError):
        files.scan_project_dir(spark, str(tmp_path), ["other.csv"])
    with pytest.raises(ValueError):
        files.scan_project_dir(spark, str(tmp_path), ["missing.csv"])
    with pytest.raises(FileNotFoundError):
        files.scan_time_series(spark, str(tmp_path / "nowhere"))


def test_nothing_to_combine(spark, tmp_path):
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    assert files.combine_sources(spark, str(tmp_path), str(tmp_path / "out")) is None


def test_whole_flow_from_files_to_model(spark, sf_dir, tmp_path):
    from buildlens.plans import fixtures as X
    from buildlens.plans import flows
    from buildlens.schema import CANONICAL

    jobs = X.builds(spark, sf_dir)
    jobs = jobs.select(*[c for c in CANONICAL if c in jobs.columns])
    for i, dialect in enumerate(("push", "short", "job")):
        files.write_dialect(jobs.filter(F.col("tr_build_id") % 3 == i), dialect,
                            str(tmp_path / "raw" / dialect))
    combined = files.combine_sources(spark, str(tmp_path / "raw"), str(tmp_path / "all"))
    assert combined.count() == jobs.count()
    builds = flows.build_table(combined, min_rows=100, balance=0.9, top=2).checkpoint()
    importance, dropped, saved = flows.rank_and_save(builds, str(tmp_path / "out"), 0.05, trees=3)
    assert saved.count() == 2 and "build_failed" not in {
        r["Feature"] for r in importance.collect()}
    rows, _ = files.scan_project_dir(spark, str(tmp_path / "out"))
    assert rows.count() == builds.count() and not set(dropped) & set(rows.columns)
    numbered = rows.withColumn("tr_job_id", F.lit(0).cast("long"))
    space = {"time_step": [4], "reg_param": [0.01], "max_iter": [10]}
    result = M.online_validation(
        numbered, ["proj_fail_rate_recent", "tr_duration", "build_failed"], "random", top=2,
        n_folds=1, window=200, repeats=1, space=space)
    assert result.candidates.count() == 2


def test_validate_picks_a_bellwether_and_scores_the_rest(separable):
    from buildlens.plans import flows

    # a quarter of the signal is lost, so that no metric is too good
    lost = F.pmod(F.xxhash64("tr_build_id", "gh_project_name", F.lit(5)), F.lit(4)) == 0
    weak = separable.withColumn(
        "signal", F.when(lost, F.col("noise") * 3).otherwise(F.col("signal")))
    space = {"time_step": [3], "reg_param": [0.1], "max_iter": [30]}
    result = flows.validate(
        weak, FEATURES, "random", cross=dict(space=space),
        online=dict(top=3, n_folds=2, window=300, step=60, repeats=2, space=space,
                    threshold_from="test"))
    entries = result.online.entries.collect()
    # the gate drops entries, of 3 projects x 2 folds x 2 repeats
    assert 1 <= len(entries) <= 12 and all(0.75 < e["AUC"] <= 0.99 for e in entries)
    best = max({e["proj"] for e in entries}, key=lambda p: (
        sum(e["F1"] for e in entries if e["proj"] == p)
        / sum(1 for e in entries if e["proj"] == p)))
    assert result.bellwether == best
    crossed = result.cross.entries.collect()
    assert {e["proj"] for e in crossed} <= {"a", "b", "c"} - {best}
    assert all(e["AUC"] > 0.75 for e in crossed)
    assert {r["proj"] for r in result.cross.scored.select("proj").distinct().collect()} == {
        "a", "b", "c"} - {best}


def test_a_bellwether_whose_models_are_all_refused_has_no_entries(separable):
    # the signal says it all, so that every model is too good to be true
    result = M.cross_project_validation(
        separable, "a", FEATURES, "default", repeats=2,
        space={"time_step": [3], "reg_param": [0.0], "max_iter": [30]})
    assert result.model is None and len(result.training) == 2
    assert all(max(e[m] for m in M.METRICS) > M.GATE_LIMIT for e in result.training)
    assert result.scored.count() == 0 and result.entries.count() == 0
    assert {"proj", "F1", "AUC", "threshold", "algo"} <= set(result.entries.columns)
    assert [r["entries"] for r in result.summary.collect()] == [0]


def _plans_of(monkeypatch, name, argument):
    """The physical plans of what a function of the module gets, filled in as it is called."""
    plans, real = [], getattr(M, name)

    def seen(*args, **kwargs):
        plans.append(argument(args)._jdf.queryExecution().executedPlan().toString())
        return real(*args, **kwargs)

    monkeypatch.setattr(M, name, seen)
    return plans


def test_adapted_fits_read_windows_that_were_cut_and_split_once(separable, monkeypatch):
    plans, real = [], M._learner

    class Spy:
        def __init__(self, *args):
            self.learner = real(*args)

        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return self.learner.fit(rows)

    monkeypatch.setattr(M, "_learner", Spy)
    entries, _ = M.adapted_validation(
        separable, "a", FEATURES, {"time_step": 3, "reg_param": 0.1, "max_iter": 10}, limit=1.0)
    assert {r["proj"] for r in entries.collect()} == {"b", "c"}
    assert len(plans) == 2 and not any("Window" in p or "Join" in p for p in plans)


def test_border_rounds_read_windows_that_were_cut_once(separable, monkeypatch):
    plans = _plans_of(monkeypatch, "_linear_map", lambda args: args[0])
    card, _ = M.border_reconstruction(separable, FEATURES, 8)
    assert card.first()["R2"] > 0.99
    assert plans and not any("Window" in p for p in plans)


def test_masked_windows_equal_windows_of_masked_rows(separable):
    cut = S.border_windows(separable, FEATURES, 8)
    masked = S.masked_windows(cut.drop("target"), FEATURES, ["noise"])
    columns = ["gh_project_name", "position", "window", "target"]
    before = S.border_windows(separable, FEATURES, 8, zeroed=["noise"])
    assert masked.select(*columns).exceptAll(before.select(*columns)).count() == 0
    assert masked.count() == before.count() == 3 * (420 - 8)


def test_importance_models_read_one_stored_table(separable, monkeypatch):
    read, names = [], ["rf_importance", "logistic_importance", "svc_importance"]
    for name in names:
        def seen(df, *args, _real=getattr(I, name)):
            read.append(sorted(df.inputFiles()))
            return _real(df, *args)

        monkeypatch.setattr(I, name, seen)
    table = I.aggregate_importance(separable, FEATURES, trees=3, max_iter=20)
    assert {r["Feature"] for r in table.collect()} == set(FEATURES)
    assert len(read) == 3 and read[0] and read[0] == read[1] == read[2]


def test_cross_project_query_searches_the_whole_space_of_its_model(spark, sf_dir, monkeypatch):
    from buildlens.plans.catalogue import QUERIES, models

    asked = {}

    def seen(df, features, strategy, model_name, algorithm, repeats, seed, space):
        asked.update(rows=df.count(), strategy=strategy, repeats=repeats,
                     space=space or M.space_of(model_name))
        return None, []

    monkeypatch.setattr(M, "fit_project", seen)
    QUERIES["cross_project_validation"](spark, sf_dir)
    largest = models._rows(spark, sf_dir).groupBy("gh_project_name").count().agg(F.max("count"))
    assert asked == {"rows": largest.first()[0], "strategy": "genetic", "repeats": M.REPEATS,
                     "space": M.space_of("Stacked-LSTM")}


@pytest.mark.parametrize("length", [1, 4, 9])
def test_windows_of_blocks_are_the_train_windows(separable, monkeypatch, length):
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    monkeypatch.setattr(S, "TASK_CELLS", 1_000)
    source = separable.filter("gh_project_name = 'a'")
    blocks = S.window_blocks(source, FEATURES, 9, source.count())
    assert blocks.rdd.getNumPartitions() == 8  # 420 x 9 x 2 cells
    got = S.windows_of(blocks, length, len(FEATURES))
    wanted = S.train_windows(source, FEATURES, length, position="at").select(
        "at", F.col("build_failed").cast("double").alias("label"), F.flatten("window").alias("cells"))
    assert got.count() == wanted.count() == 420 - length
    assert got.select(*wanted.columns).exceptAll(wanted).count() == 0


def test_project_fits_equal_single_fits_and_read_a_line_that_was_cut_once(separable, monkeypatch):
    plans, real = [], M._learner

    class Spy:
        def __init__(self, *args):
            self.learner = real(*args)

        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return self.learner.fit(rows)

    source = separable.filter("gh_project_name = 'a'").withColumn("signal", F.col("noise"))
    params = {"time_step": 4, "reg_param": 0.1, "max_iter": 20}
    single = M.fit_window_classifier(S.train_windows(source, FEATURES, 4), FEATURES, params)
    monkeypatch.setattr(M, "_learner", Spy)
    space = {"time_step": [3, 4], "reg_param": [0.1], "max_iter": [20]}
    _, entries = M.fit_project(source, FEATURES, "random", space=space, repeats=6)
    assert len(entries) == 6 and len(plans) == 2
    assert not any("Window" in p or "Join" in p for p in plans)
    _, entries = M.fit_project(
        source, FEATURES, "genetic", space={n: [v] for n, v in params.items()}, repeats=1)
    assert entries == [{**{n: pytest.approx(v, abs=1e-6) for n, v in single.entry.items()}, "iter": 1}]


def test_a_length_without_windows_is_no_model(separable):
    source = separable.filter("gh_project_name = 'a'")
    space = {"time_step": [419, 420, 900], "reg_param": [0.1], "max_iter": [5]}
    # 420 rows leave one window of 419, and that is held out
    assert M.fit_project(source, FEATURES, "random", space=space, repeats=2) == (None, [])
    _, entries = M.fit_project(
        source, FEATURES, "genetic", space={**space, "time_step": [5, 900]}, repeats=6)
    assert 1 <= len(entries) <= 6 and all(e["F1"] > 0 for e in entries)
