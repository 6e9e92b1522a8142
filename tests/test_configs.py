"""Configs: accepted spellings, the round trip through files, and the tasks they stand for."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from dqimpact.plans.runner import plan_config
from dqimpact.sources import config

RAW = {
    "datasetName": "data/table.csv",
    "targetVariabile": "y",
    "machineLearningModels": ["nb", "lda"],
    "discreteFeatures": ["a", "b"],
    "categoricalFeaturesString": ["c"],
    "Experiments": [
        {"Errortype": "noise", "FeatureType": "discrete", "Step": 0.25},
        {"Errotype": "missing", "FeatureArray": ["c"], "Step": "0.5", "machineLearningModels": ["dummy"]},
        {"Errortype": "labels", "Step": 0.2},
        {"Errortype": "duplicated", "Step": 0.5, "case": "class", "target_value": "1"},
    ],
}


def test_round_trip_and_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(RAW))
    read = config.read_configs(spark, str(tmp_path / "one.json"))
    first = config.to_config(read.first())
    config.write_configs(read, str(tmp_path / "out"))
    again = config.to_config(config.normalise_configs(spark.read.schema(config.CONFIG).json(str(tmp_path / "out"))).first())
    assert again == first and len(first.experiments) == 4

    schema = T.StructType().add("a", "integer").add("b", "double").add("c", "string").add("y", "integer")
    tasks = plan_config(first, schema).tasks
    assert [(t.error, t.feature, t.role) for t in tasks] == [
        ("noise", "a", "discrete"), ("noise", "b", "discrete"), ("missing", "c", "categoricalString"),
        ("labels", "y", "target"), ("duplicate", "y", "target"),
    ]
    assert [s.share for s in tasks[0].levels] == [0.25, 0.5, 0.75]
    assert tasks[2].models == ("dummy",) and tasks[0].models == ("nb", "lda")
    assert tasks[4].target_value == 1
