"""Experiment configs: JSON documents read with Spark into typed rows and Python objects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = T.ArrayType(T.StringType())

EXPERIMENT = T.StructType(
    [
        T.StructField("Errortype", T.StringType()),
        T.StructField("Errotype", T.StringType()),
        T.StructField("FeatureType", T.StringType()),
        T.StructField("Step", T.StringType()),
        T.StructField("columns", _NAMES),
        T.StructField("FeatureArray", _NAMES),
        T.StructField("machineLearningModels", _NAMES),
        T.StructField("case", T.StringType()),
        T.StructField("target_value", T.StringType()),
    ]
)

CONFIG = T.StructType(
    [
        T.StructField("datasetName", T.StringType()),
        T.StructField("testset", T.StringType()),
        T.StructField("outputDirectory", T.StringType()),
        T.StructField("targetVariable", T.StringType()),
        T.StructField("targetVariabile", T.StringType()),
        T.StructField("machineLearningModels", _NAMES),
        T.StructField("discreteFeatures", _NAMES),
        T.StructField("continousFeatures", _NAMES),
        T.StructField("categoricalFeaturesString", _NAMES),
        T.StructField("categoricalFeaturesInteger", _NAMES),
        T.StructField("binaryFeatures", _NAMES),
        T.StructField("Experiments", T.ArrayType(EXPERIMENT)),
    ]
)

# Role -> config field, in the order in which roles are looked up.
ROLE_FIELDS = {
    "discrete": "discreteFeatures",
    "continous": "continousFeatures",
    "categoricalString": "categoricalFeaturesString",
    "categoricalInteger": "categoricalFeaturesInteger",
    "binary": "binaryFeatures",
}

# Role -> label in the features dimension.
ROLE_LABELS = {
    "discrete": "discrete",
    "continous": "continue",
    "categoricalString": "categorical String",
    "categoricalInteger": "categorical Integer",
    "binary": "binary",
    "target": "target",
}

# Model name shown to the user -> short code in configs.
MODEL_CODES = {
    "Logistic Regression": "lr",
    "K-Nearest Neighbors": "knn",
    "Naive Bayes": "nb",
    "Support Vector Machine": "svm",
    "Decision Tree": "dt",
    "Radial Basis Function SVM": "rbfsvm",
    "Gaussian Process Classifier": "gpc",
    "Multi-Layer Perceptron": "mlp",
    "Ridge Classifier": "ridge",
    "Quadratic Discriminant Analysis": "qda",
    "AdaBoost": "ada",
    "Linear Discriminant Analysis": "lda",
    "Dummy Classifier": "dummy",
    "Random Forest": "rf",
    "Extra Trees": "et",
    "Gradient Boosting Classifier": "gbc",
    "LightGBM": "lightgbm",
    "CatBoost": "catboost",
}

# Spellings found in configs -> the spelling used here.
ERROR_SPELLINGS = {"duplicated": "duplicate"}
ROLE_SPELLINGS = {"categoricalInt": "categoricalInteger"}


@dataclass(frozen=True)
class FeatureSpec:
    """Columns of a dataset by role."""

    target: str
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def role(self, name: str) -> list[str]:
        return list(self.roles.get(ROLE_SPELLINGS.get(name, name), ()))

    @property
    def features(self) -> list[str]:
        return [column for role in ROLE_FIELDS for column in self.role(role)]

    def role_of(self, column: str) -> str:
        if column == self.target:
            return "target"
        for role in ROLE_FIELDS:
            if column in self.role(role):
                return role
        raise KeyError(f"{column} has no role")


@dataclass(frozen=True)
class Experiment:
    error: str
    role: str | None = None
    step: float | None = None
    features: tuple[str, ...] | None = None
    models: tuple[str, ...] | None = None
    case: str = "all"
    target_value: str | None = None


@dataclass(frozen=True)
class Config:
    dataset: str
    spec: FeatureSpec
    models: tuple[str, ...]
    experiments: tuple[Experiment, ...]
    testset: str | None = None

    def features_for(self, experiment: Experiment) -> list[str]:
        """Own list of the experiment first, then all columns of its role, then all features."""
        if experiment.features is not None:
            return list(experiment.features)
        if experiment.role is not None:
            return self.spec.role(experiment.role)
        return self.spec.features


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def table_name(name: Column) -> Column:
    """Name under which a file is known in the warehouse."""
    return F.replace(name, F.lit("-"), F.lit("_"))


def read_configs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per config file, with the accepted spellings brought to one form."""
    raw = spark.read.schema(CONFIG).json(path, multiLine=True)
    return normalise_configs(raw.withColumn("file", base_name(F.col("_metadata.file_path"))))


def normalise_configs(raw: DataFrame) -> DataFrame:
    def spelled(c: Column, spellings: dict[str, str]) -> Column:
        for old, new in spellings.items():
            c = F.when(c == old, F.lit(new)).otherwise(c)
        return c

    def tidy(e: Column) -> Column:
        return F.struct(
            spelled(F.coalesce(e["Errortype"], e["Errotype"]), ERROR_SPELLINGS).alias("error"),
            spelled(e["FeatureType"], ROLE_SPELLINGS).alias("role"),
            e["Step"].try_cast("double").alias("step"),
            F.coalesce(e["FeatureArray"], e["columns"]).alias("features"),
            e["machineLearningModels"].alias("models"),
            F.coalesce(e["case"], F.lit("all")).alias("case"),
            e["target_value"].alias("target_value"),
        )

    keep = [name for name in ("file",) if name in raw.columns]
    return raw.select(
        *keep,
        base_name(F.col("datasetName")).alias("datasetName"),
        base_name(F.col("testset")).alias("testset"),
        F.coalesce("targetVariable", "targetVariabile").alias("targetVariable"),
        "machineLearningModels",
        *ROLE_FIELDS.values(),
        F.transform("Experiments", tidy).alias("experiments"),
    )


def to_config(row: Row) -> Config:
    """Typed config from one row of `read_configs`."""
    if not row["targetVariable"]:
        raise ValueError(f"config of {row['datasetName']} names no targetVariable")
    spec = FeatureSpec(
        target=row["targetVariable"],
        roles={role: tuple(row[name] or ()) for role, name in ROLE_FIELDS.items()},
    )
    experiments = tuple(
        Experiment(
            error=e["error"],
            role=e["role"],
            step=e["step"],
            features=None if e["features"] is None else tuple(e["features"]),
            models=None if e["models"] is None else tuple(e["models"]),
            case=e["case"],
            target_value=e["target_value"],
        )
        for e in row["experiments"] or ()
    )
    return Config(
        dataset=row["datasetName"],
        spec=spec,
        models=tuple(row["machineLearningModels"] or ()),
        experiments=experiments,
        testset=row["testset"] or None,
    )


def load_config(spark: SparkSession, path: str) -> Config:
    return to_config(read_configs(spark, path).first())


def model_codes(names: Column) -> Column:
    """Short codes for an array of model names; unknown names stay as they are."""
    table = F.create_map(*[F.lit(text) for pair in MODEL_CODES.items() for text in pair])
    return F.transform(names, lambda name: F.coalesce(F.try_element_at(table, name), name))


def write_configs(configs: DataFrame, path: str) -> None:
    """Write config rows in the form that read_configs reads, a file for each, with model names as short codes."""

    def given(e: Column) -> Column:
        return F.struct(
            e["error"].alias("Errortype"),
            e["role"].alias("FeatureType"),
            e["step"].cast("string").alias("Step"),
            e["features"].alias("FeatureArray"),
            e["models"].alias("machineLearningModels"),
            e["case"].alias("case"),
            e["target_value"].alias("target_value"),
        )

    coded = configs.withColumn("machineLearningModels", model_codes(F.col("machineLearningModels")))
    coded.select(
        *[c for c in coded.columns if c not in ("file", "experiments")],
        F.transform("experiments", given).alias("Experiments"),
    ).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def features_dim(configs: DataFrame) -> DataFrame:
    """(datasetName, feature, type), one row per feature: several configs may share a dataset.

    Where configs disagree, the role that comes first in ROLE_LABELS wins.
    """
    order = list(ROLE_LABELS)

    def of_role(role: str, names: Column) -> Column:
        return F.transform(
            F.coalesce(names, F.array().cast(_NAMES)),
            lambda name: F.struct(
                name.alias("feature"),
                F.lit(order.index(role)).alias("place"),
                F.lit(ROLE_LABELS[role]).alias("type"),
            ),
        )

    parts = [of_role(role, F.col(name)) for role, name in ROLE_FIELDS.items()]
    parts.append(of_role("target", F.filter(F.array("targetVariable"), lambda t: t.isNotNull())))
    rows = configs.select("datasetName", F.inline(F.concat(*parts)))
    return rows.groupBy("datasetName", "feature").agg(F.min_by("type", "place").alias("type"))
