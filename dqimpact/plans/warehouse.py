"""The MODPERF fact with its feature and model dimensions, built from sets of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, class name, shown name, family.
MODELS = [
    (1, "LogisticRegression", "Logistic Regression", "Linear"),
    (2, "RidgeClassifier", "Ridge Classifier", "Linear"),
    (3, "LinearDiscriminantAnalysis", "Linear Discriminant Analysis", "Linear"),
    (4, "SGDClassifier", "SGD Classifier", "Linear"),
    (5, "SVC", "Support Vector Machine", "Linear"),
    (6, "GaussianNB", "Gaussian Naive Bayes", "Probabilistic"),
    (7, "GaussianProcessClassifier", "Gaussian Process Classifier", "Probabilistic"),
    (8, "QuadraticDiscriminantAnalysis", "Quadratic Discriminant Analysis", "Probabilistic"),
    (9, "MLPClassifier", "MLP Classifier", "Neural Networks"),
    (10, "DummyClassifier", "Dummy Classifier", "Heuristic based"),
    (11, "KNeighborsClassifier", "K-Neighborg Classifier", "Neighborg based"),
    (12, "ExtraTreesClassifier", "Extra Tree Classifier", "Single Tree"),
    (13, "DecisionTreeClassifier", "Decision Tree Classifier", "Single Tree"),
    (14, "RandomForestClassifier", "Random Forest Classifier", "Ensemble Tree"),
    (15, "GradientBoostingClassifier", "Gradient Boosting Classifier", "Ensemble Tree"),
    (16, "AdaBoostClassifier", "Ada Boost Classifier", "Ensemble Tree"),
    (17, "CatBoostClassifier", "Cat Boost Classifier", "Ensemble Tree"),
    (18, "LGBMClassifier", "Light GBM", "Ensemble Tree"),
]

# Column of a result row -> column of the fact.
RENAMES = {
    "Accuracy": "ACC",
    "Precision": "PREC",
    "Recall": "REC",
    "F1": "F1",
    "Auc": "AUC",
    "datasetName": "DATASETNAME",
    "errorType": "ERRTYPE",
    "percentage": "ERRPERC",
    "feature": "FEATNAME",
    "modelName": "MODELNAME",
}
# Columns of the fact in order.
MODPERF = [
    "ACC", "PREC", "REC", "EPC", "F1", "AUC", "DATASETNAME", "ERRTYPE", "ERRPERC", "FEATTYPE", "FEATNAME",
    "MODELNAME", "MODELTYPE",
]


def models_dim(spark: SparkSession) -> DataFrame:
    schema = "ID int, MODELLOCALNAME string, MODELNAME string, MODELTYPE string"
    return spark.createDataFrame(MODELS, schema)


def load_fact(results: DataFrame) -> DataFrame:
    """Result rows under the names of the fact; a missing AUC counts as 0."""
    fact = results.select(*[F.col(old).alias(new) for old, new in RENAMES.items()])
    return fact.withColumn("AUC", F.coalesce("AUC", F.lit(0.0)))


def attach_epc(fact: DataFrame, at: DataFrame) -> DataFrame:
    """Add EPC; the dataset belongs to the key, since feature names recur between datasets."""
    points = at.groupBy(
        F.col("datasetName").alias("DATASETNAME"),
        F.col("errorType").alias("ERRTYPE"),
        F.col("modelName").alias("MODELNAME"),
        F.col("feature").alias("FEATNAME"),
        F.col("percentage").alias("ERRPERC"),
    ).agg(F.max("epc_at").alias("EPC"))
    return fact.join(points, ["DATASETNAME", "ERRTYPE", "MODELNAME", "FEATNAME", "ERRPERC"], "left")


def attach_models(fact: DataFrame) -> DataFrame:
    """Shown name and family of each model; an unknown class keeps its name."""
    models = models_dim(fact.sparkSession).select(
        F.col("MODELLOCALNAME"), F.col("MODELNAME").alias("shown"), "MODELTYPE"
    )
    joined = fact.join(F.broadcast(models), fact["MODELNAME"] == F.col("MODELLOCALNAME"), "left")
    named = joined.withColumn("MODELNAME", F.coalesce("shown", "MODELNAME"))
    return named.drop("shown", "MODELLOCALNAME")


def attach_feature_types(fact: DataFrame, features: DataFrame) -> DataFrame:
    """Role of each feature; the dimension holds one row per (dataset, feature)."""
    types = features.select(
        F.col("datasetName").alias("DATASETNAME"), F.col("feature").alias("FEATNAME"), F.col("type").alias("FEATTYPE")
    )
    return fact.join(types, ["DATASETNAME", "FEATNAME"], "left")


def baseline_rows(fact: DataFrame) -> DataFrame:
    """The error-free scores of each model, repeated at level 0 of all its series.

    Both sides are reduced to distinct rows before they meet, so the join gives distinct rows.
    """
    keys = ["DATASETNAME", "MODELNAME"]
    start = fact.filter(F.col("ERRPERC") == 0.0).select(*keys, "ACC", "PREC", "REC", "F1", "AUC").distinct()
    series = fact.select(*keys, "FEATNAME", "FEATTYPE", "ERRTYPE", "MODELTYPE").distinct()
    fanned = start.join(series, keys)
    return fanned.select(
        *[
            F.lit(None).cast("double").alias("EPC") if c == "EPC"
            else F.lit(0.0).alias("ERRPERC") if c == "ERRPERC"
            else F.col(c)
            for c in MODPERF
        ]
    )


def modperf(results: DataFrame, at: DataFrame, features: DataFrame) -> DataFrame:
    """The whole fact: scores, EPC, model families, feature roles, and the fanned-out baselines.

    EPC is attached before model names change, because EPC rows carry class names.
    """
    fact = attach_feature_types(attach_models(attach_epc(load_fact(results), at)), features).select(*MODPERF)
    return fact.unionByName(baseline_rows(fact))
