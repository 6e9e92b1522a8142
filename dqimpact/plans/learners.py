"""Spark ML learners in sweeps, and how much their features matter.

Every fit is a distributed Spark ML job over the stored cell; only coefficients and importances, one
number for each design column, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.operators.inject import DUPLICATE, ERROR_NAMES, LABELS, Key, duplicate, inject, wrong_labels
from dqimpact.operators.neighbours import counts_of_stored, store_for_later
from dqimpact.plans.importance import REPEATS, label_importance
from dqimpact.plans.stumps import fit_stumps, stump_counts, test_rows, training_rows
from dqimpact.plans.sweep import Cell, Task, cell_labels, decision_counts, score_counts
from dqimpact.session import shared_folder
from dqimpact.sources.config import FeatureSpec
from dqimpact.sources.tables import NO_ERROR

SEED = 42
FOLDS = 5
TOP = 10
LEAST_WEIGHT = 0.01

# Config code -> class name in the result tables.
NAMES = {
    "lr": "LogisticRegression",
    "svm": "SGDClassifier",
    "dt": "DecisionTreeClassifier",
    "rf": "RandomForestClassifier",
    "gbc": "GradientBoostingClassifier",
    "mlp": "MLPClassifier",
    "ada": "AdaBoostClassifier",
    "knn": "KNeighborsClassifier",
}


def learner(code: str, width: int) -> Estimator:
    at = {"featuresCol": "design", "labelCol": "y"}
    made: dict[str, Callable[[], Estimator]] = {
        "lr": lambda: LogisticRegression(**at),
        "svm": lambda: LinearSVC(regParam=1e-4, **at),
        "dt": lambda: DecisionTreeClassifier(seed=SEED, **at),
        "rf": lambda: RandomForestClassifier(seed=SEED, **at),
        "gbc": lambda: GBTClassifier(seed=SEED, maxIter=20, **at),
        "mlp": lambda: MultilayerPerceptronClassifier(seed=SEED, layers=[width, 8, 2], **at),
    }
    return made[code]()


def design_stages(spec: FeatureSpec) -> list[Estimator]:
    """Numbers with gaps filled by the mean, texts as indicators, all scaled."""
    texts = spec.role("categoricalString")
    numbers = [c for c in spec.features if c not in texts]
    filled = [f"_f{i}" for i, _ in enumerate(numbers)]
    codes, spread = [f"_c{i}" for i, _ in enumerate(texts)], [f"_o{i}" for i, _ in enumerate(texts)]
    stages: list = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=filled))
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=spread, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*filled, *spread], outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="design", withMean=False))
    return stages


def prepared(df: DataFrame, spec: FeatureSpec, *keep: str) -> DataFrame:
    """The target as y, numbers as doubles; rows without a target are left out."""
    texts = spec.role("categoricalString")
    return df.filter(F.col(spec.target).isNotNull()).select(
        *keep,
        F.col(spec.target).cast("double").alias("y"),
        *[F.col(c) if c in texts else F.col(c).cast("double").alias(c) for c in spec.features],
    )


def design_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the design columns in order: the feature, with its category where it has some."""
    numbers = [c for s in model.stages if hasattr(s, "surrogateDF") for c in s.getInputCols()]
    texts: list[str] = []
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            for column, labels in zip(stage.getInputCols(), stage.labelsArray, strict=True):
                # Unknown values have a place of their own; one more is left out by the encoder.
                texts += [f"{column}={v}" for v in labels] + [f"{column}=?"]
    return [*numbers, *texts]


def _damaged(train: DataFrame, spec: FeatureSpec, task: Task, share: float, key: Key, seed: int) -> DataFrame:
    if task.error == LABELS:
        return wrong_labels(train, spec.target, share, key, seed)
    if task.error == DUPLICATE:
        target = spec.target if task.target_value is not None else None
        return duplicate(train, share, key, seed, target=target, target_value=task.target_value).drop("is_copy")
    return inject(train, task.feature, task.role, task.error, share, key, seed)


# Learners without a score that ranks rows.
WITHOUT_SCORE = {"svm"}
# Damaged tables that are worked on at the same time; each of their jobs is spread over the cluster.
PARALLEL = 8
# Rows of a damaged table that one task of an iteration gets.
TASK_ROWS = 50_000


def _decision(code: str) -> Column:
    """Positive where class 1 is predicted, and rising with its probability where the learner gives one."""
    if code in WITHOUT_SCORE:
        return F.col("prediction") - 0.5
    return vector_to_array("probability")[1] - 0.5


def _counts_of_models(
    rows: DataFrame, test: DataFrame, spec: FeatureSpec, models: Sequence[tuple[int, str]], later: str
) -> DataFrame | None:
    """Decision counts of all models (number, code) fitted on one table.

    Rows of those that work on all tables at once go to the folder `later`.
    """
    rows = prepared(rows, spec).persist()
    total = rows.count()
    shaped = Pipeline(stages=design_stages(spec)).fit(rows)
    design = shaped.transform(rows).select("design", "y")
    # An iteration is a job, so that few rows are better in few tasks.
    few = design.coalesce(max(1, -(-total // TASK_ROWS))).persist()
    seen = shaped.transform(test).select("design", "y")
    first = design.first()
    width = first["design"].size if first else 1
    counts = []
    for number, code in models:
        name = F.lit(number).alias("model")
        if code == "knn":
            store_for_later(_vectors(design), _vectors(seen), width, number, f"{later}/{code}")
            continue
        elif code == "ada":
            training_rows(design, total).write.parquet(f"{later}/{code}/train/table={number}")
            test_rows(seen).write.parquet(f"{later}/{code}/test/table={number}")
            continue
        else:
            # The draws of a forest go by its partitions, and it has few jobs.
            fitted = learner(code, width).fit(design if code == "rf" else few)
            found = decision_counts(fitted.transform(seen).select(name, "y", _decision(code).alias("decision")))
        counts.append(found)
    few.unpersist()
    rows.unpersist()
    return reduce(DataFrame.unionByName, counts) if counts else None


def _vectors(design: DataFrame) -> DataFrame:
    return design.select(vector_to_array("design").alias("vector"), "y")


def ml_sweep(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, tasks: Sequence[Task], key: str, dataset: str,
    models: Sequence[str], seed: int = SEED,
) -> DataFrame:
    """Result rows of every (error, feature, level, model), the clean table included.

    Each damaged table is fitted and scored on its own, several at a time, and leaves the counts of its
    decisions in the shared folder; boosted stumps of all tables grow together once the tables are made,
    and the neighbours of all tables are searched together.
    One pass over the counts scores all cells.
    """
    tables = [(models, Cell(NO_ERROR, 0.0, NO_ERROR, ""), lambda: train)] if models else []
    for task in tasks:
        feature = spec.target if task.error in (LABELS, DUPLICATE) else task.feature
        for level in task.levels:
            made = partial(_damaged, train, spec, task, level.share, key, seed)
            tables.append((task.models, Cell(ERROR_NAMES[task.error], level.label, feature, ""), made))
    cells: list[Cell] = []
    numbered = []
    for codes, cell, made in tables:
        numbered.append(([(len(cells) + i, code) for i, code in enumerate(codes)], made))
        cells += [replace(cell, code=code) for code in codes]

    spark, clean_test = train.sparkSession, prepared(test, spec).persist()
    path, later = shared_folder(spark, "decisions"), shared_folder(spark, "later")

    def work(place: int) -> None:
        codes, made = numbered[place]
        counts = _counts_of_models(made(), clean_test, spec, codes, later)
        if counts is not None:
            counts.write.parquet(f"{path}/table={place}")

    # Jobs of several threads share the executors, as in a cross-validation.
    with ThreadPoolExecutor(PARALLEL) as pool:
        list(pool.map(inheritable_thread_target(spark)(work), range(len(numbered))))
    if any(cell.code == "ada" for cell in cells):
        train_rows = spark.read.schema("x array<double>, y double, n double, s double, table int").parquet(f"{later}/ada/train")
        asked = spark.read.schema("x array<double>, pos double, neg double, table int").parquet(f"{later}/ada/test")
        told = stump_counts(fit_stumps(train_rows), asked)
        told.withColumnRenamed("table", "model").write.parquet(f"{path}/table={len(numbered)}")
    if any(cell.code == "knn" for cell in cells):
        told = counts_of_stored(spark, f"{later}/knn").groupBy(F.col("table").alias("model"), "decision")
        told.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).write.parquet(f"{path}/table={len(numbered) + 1}")
    clean_test.unpersist()
    counts = spark.read.schema("model int, decision double, pos long, neg long").parquet(path)
    unscored = [i for i, cell in enumerate(cells) if cell.code in WITHOUT_SCORE]
    return score_counts(counts, cell_labels(test, dataset, cells, NAMES), unscored)


def stratified_folds(rows: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """Add `fold`: rows of each class are dealt by a hash of their key."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "y", key), F.lit(folds)).cast("int"))


def _validated(rows: DataFrame, spec: FeatureSpec, key: str, estimator: Estimator, grid: list) -> tuple[PipelineModel, object]:
    shaped = Pipeline(stages=design_stages(spec)).fit(rows)
    design = stratified_folds(shaped.transform(rows).select(key, "design", "y"), key).persist()
    measure = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=measure, numFolds=FOLDS, foldCol="fold", seed=SEED, parallelism=PARALLEL
    )
    best = search.fit(design).bestModel
    design.unpersist()
    return shaped, best


def _ranked(rows: DataFrame, shaped: PipelineModel, values: Sequence[float], top: int) -> DataFrame:
    names = design_names(shaped, rows)
    pairs = sorted(zip(names, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))[:top]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return rows.sparkSession.createDataFrame(pairs, schema)


def _best_l1(rows: DataFrame, spec: FeatureSpec, key: str) -> tuple[PipelineModel, object]:
    model = LogisticRegression(featuresCol="design", labelCol="y", elasticNetParam=1.0)
    return _validated(rows, spec, key, model, ParamGridBuilder().addGrid(model.regParam, [0.001, 0.01, 0.1]).build())


def _best_forest(rows: DataFrame, spec: FeatureSpec, key: str) -> tuple[PipelineModel, object]:
    model = RandomForestClassifier(featuresCol="design", labelCol="y", seed=SEED)
    grid = (
        ParamGridBuilder()
        .addGrid(model.featureSubsetStrategy, ["sqrt", "log2", "onethird", "all"])
        .addGrid(model.minInstancesPerNode, [1, 5, 20])
        .build()
    )
    return _validated(rows, spec, key, model, grid)


def l1_importance(train: DataFrame, spec: FeatureSpec, key: str, top: int = TOP) -> DataFrame:
    """(feature, importance): the largest positive and the largest negative weights, up to `top` of each.

    They are those of an L1 logistic regression, its penalty picked by cross-validation; weights next to
    zero are left out.
    """
    rows = prepared(train, spec, key)
    shaped, best = _best_l1(rows, spec, key)
    weights = best.coefficients.toArray()
    found = _ranked(rows, shaped, weights, len(weights))
    rising = found.filter(F.col("importance") > LEAST_WEIGHT).orderBy(F.desc("importance"), "feature").limit(top)
    falling = found.filter(F.col("importance") < -LEAST_WEIGHT).orderBy("importance", "feature").limit(top)
    return rising.unionByName(falling)


def forest_importance(train: DataFrame, spec: FeatureSpec, key: str, top: int = TOP) -> DataFrame:
    """(feature, importance): Gini importance of a random forest picked by cross-validation."""
    rows = prepared(train, spec, key)
    shaped, best = _best_forest(rows, spec, key)
    return _ranked(rows, shaped, best.featureImportances.toArray(), top)


def permutation_importance(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, key: str, repeats: int = REPEATS
) -> DataFrame:
    """(model, feature, repeat, importance) of the L1 logistic regression and of the forest that cross-validation picks."""
    rows, seen = prepared(train, spec, key), prepared(test, spec, key)
    parts = []
    for code, found in (("lr", _best_l1(rows, spec, key)), ("rf", _best_forest(rows, spec, key))):
        importances = label_importance(*found, seen, spec.features, key, repeats)
        parts.append(importances.select(F.lit(NAMES[code]).alias("model"), "feature", "repeat", "importance"))
    return reduce(DataFrame.unionByName, parts)
