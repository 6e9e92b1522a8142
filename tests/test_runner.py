"""From config files to stored results: what is planned, what is left out and why, and what a rerun replaces."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.plans import learners, runner
from dqimpact.plans.sweep import Task, moment_sweep
from dqimpact.operators import inject
from dqimpact.sources.config import Config, Experiment, FeatureSpec, read_configs
from dqimpact.sources.tables import load_results

SCHEMA = T.StructType().add("id", "long").add("d", "integer").add("c", "double").add("s", "string").add("k", "integer")
SCHEMA = SCHEMA.add("b", "integer").add("y", "integer")
ROLES = {
    "discrete": ("d", "gone"), "continous": ("c",), "categoricalString": ("s",), "categoricalInteger": ("k",), "binary": ("b", "d"),
}


def planned(*experiments: Experiment, models=("nb", "lr")) -> runner.Plan:
    return runner.plan_config(Config("t", FeatureSpec("y", ROLES), models, experiments), SCHEMA)


def test_models_are_routed_and_unknown_ones_named():
    plan = planned(Experiment("noise", "discrete", 0.5, models=("nb", "lr", "xgboost", "dt", "nb")))
    moment, spark_ml = plan.part(runner.FITS)[0], plan.part(runner.NAMES)[0]
    assert [t.models for t in moment] == [("nb",)] and [t.models for t in spark_ml] == [("lr", "dt")]
    assert runner.Skipped("noise", "xgboost", "no learner for this model") in plan.skipped
    assert not plan.baseline


def test_baseline_takes_its_own_models_or_those_of_the_config():
    assert planned(Experiment("standard")).baseline == ("nb", "lr")
    assert planned(Experiment("standard", models=("svm", "nb"))).baseline == ("svm", "nb")
    assert planned(Experiment("standard", models=("svm",)), Experiment("standard")).baseline == ("svm", "nb", "lr")


def test_what_cannot_be_run_is_named():
    plan = planned(
        Experiment("outlier"), Experiment("outlier", "binary"), Experiment("spelling", "discrete"),
        Experiment("noise", "discrete", -1.0), Experiment("noise", "discrete", 2.0), Experiment("missing", features=("nobody", "s")),
        Experiment("duplicate", case="class", target_value="one"), Experiment("noise", "discrete", features=("s", "y")),
    )
    told = {(s.error, s.what): s.reason for s in plan.skipped}
    assert told["outlier", "b"] == "no outlier error for binary features"
    assert told[None, "gone"] == "no such column" and told["missing", "nobody"] == "no role"
    assert {("spelling", "discrete"), ("noise", "d"), ("duplicate", "one"), ("noise", "s"), ("noise", "y")} <= set(told)
    assert [(t.error, t.feature) for t in plan.tasks] == [*(("outlier", f) for f in "dcsk"), ("missing", "s")]
    # A column belongs to the first role that lists it.
    assert plan.spec.roles["binary"] == ("b",) and plan.spec.roles["discrete"] == ("d",)


def test_experiments_that_agree_run_once():
    plan = planned(Experiment("missing", step=0.5), Experiment("missing", features=("d",), step=0.5, models=("lda",)))
    (task,) = [t for t in plan.tasks if t.feature == "d"]
    assert task.models == ("nb", "lr", "lda")


@pytest.mark.parametrize("target", [None, "nowhere", "s"])
def test_configs_without_a_usable_target_come_to_nothing(spark, tmp_path, target):
    raw = {"datasetName": "t", "discreteFeatures": ["d"], "machineLearningModels": ["nb"], "Experiments": [{"Errortype": "labels"}]}
    (tmp_path / "a.json").write_text(json.dumps(raw | ({"targetVariable": target} if target else {})))
    plan = runner.plan_row(read_configs(spark, str(tmp_path)).first(), SCHEMA)
    assert plan.spec is None and len(plan.skipped) == 1


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (i, i % 17, (i * 37 % 101) / 7.0, "abc"[i * 5 % 3] if i % 11 else None, i % 4, int(i % 3 == 0), int((i * 37 % 101) + i % 9 > 55))
        for i in range(240)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _config(name: str, **more) -> str:
    raw = {
        "datasetName": f"somewhere/{name}", "targetVariable": "y", "machineLearningModels": ["nb", "ridge", "lr", "et"],
        "discreteFeatures": ["d"], "continousFeatures": ["c"], "categoricalFeaturesString": ["s"],
        "categoricalFeaturesInteger": ["k"], "binaryFeatures": ["b"],
        "Experiments": [
            {"Errortype": "standard"},
            {"Errortype": "noise", "FeatureType": "categoricalInt", "Step": "0.5"},
            {"Errortype": "outlier", "Step": 0.5, "machineLearningModels": ["nb"]},
            {"Errortype": "labels", "Step": 0.5, "machineLearningModels": ["lr", "ridge"]},
            {"Errortype": "duplicated", "Step": 0.5, "case": "class", "target_value": 1, "machineLearningModels": ["nb"]},
        ],
    }
    return json.dumps(raw | more)


def test_run_of_two_datasets_and_rerun_of_one(spark, people, tmp_path):
    configs, results = tmp_path / "configs", str(tmp_path / "results")
    configs.mkdir()
    (configs / "one.json").write_text(_config("one"))
    (configs / "two.json").write_text(_config("two", testset="apart", machineLearningModels=["nb"]))
    read = {"one": people, "two": people, "apart": people.filter("id % 3 = 0").select("y", *SCHEMA.names[:-1])}
    skipped = runner.run_configs(spark, str(configs), results, read.__getitem__, "id")
    assert {s.what for s in skipped} == {"et", "b"}
    rows = load_results(spark, results)
    keys = ["datasetName", "errorType", "percentage", "feature", "modelName"]
    assert rows.count() == rows.select(*keys).distinct().count()
    one = rows.filter("datasetName = 'one'")
    assert {(r[0], r[1]) for r in one.select("errorType", "feature").distinct().collect()} == {
        ("NULL", "NULL"), ("Noisy", "k"), ("Outlier", "d"), ("Outlier", "c"), ("Outlier", "s"), ("Outlier", "k"), ("Labels", "y"),
        ("DuplicatedAll", "y"),
    }
    assert one.filter("modelName = 'RidgeClassifier'").agg(F.max("Auc")).first()[0] is None
    assert one.filter("modelName <> 'RidgeClassifier' and Auc is null").count() == 0
    # The moment rows are those of the sweep itself, over the same split.
    train, test = runner.split(people, "id")
    spec = FeatureSpec("y", {k: tuple(x for x in v if x != "gone") for k, v in ROLES.items()} | {"binary": ("b",)})
    tasks = [Task(inject.NOISE, "k", "categoricalInteger", tuple(inject.levels(0.5)), ("nb",))]
    direct = moment_sweep(train, test, spec, tasks, "id", "one", ("nb",))
    wanted = one.filter("modelName = 'GaussianNB' and errorType in ('NULL', 'Noisy')")
    assert sorted(map(tuple, wanted.collect())) == sorted(map(tuple, direct.collect()))

    before = sorted(map(tuple, rows.filter("datasetName = 'two'").collect()))
    (configs / "two.json").unlink()
    (configs / "one.json").write_text(_config("one", machineLearningModels=["dummy"], Experiments=[{"Errortype": "standard"}]))
    runner.run_configs(spark, str(configs), results, read.__getitem__, "id")
    again = load_results(spark, results)
    assert [r["modelName"] for r in again.filter("datasetName = 'one'").collect()] == ["DummyClassifier"]
    assert sorted(map(tuple, again.filter("datasetName = 'two'").collect())) == before


def test_scores_of_a_learner_against_its_own_probabilities(spark, people):
    """The area under the curve of logistic regression by counting all pairs."""
    spec = FeatureSpec("y", {"discrete": ("d",), "continous": ("c",)})
    train, test = people.filter("id % 4 > 0"), people.filter("id % 4 = 0")
    row = learners.ml_sweep(train, test, spec, [], "id", "t", ("lr", "svm"))
    got = {r["modelName"]: r for r in row.collect()}
    rows = learners.prepared(train, spec)
    shaped = learners.Pipeline(stages=learners.design_stages(spec)).fit(rows)
    model = learners.learner("lr", 2).fit(shaped.transform(rows))
    seen = [(r["probability"][1], r["y"]) for r in model.transform(shaped.transform(learners.prepared(test, spec))).collect()]
    pairs = [(p > q) + (p == q) / 2 for p, y in seen for q, z in seen if y == 1 and z == 0]
    assert got["LogisticRegression"]["Auc"] == round(sum(pairs) / len(pairs), 4)
    assert got["LogisticRegression"]["Accuracy"] == round(sum((p > 0.5) == y for p, y in seen) / len(seen), 4)
    assert got["SGDClassifier"]["Auc"] is None
