"""AdaBoost over shallow Spark ML trees: rows that a tree gets wrong weigh more in the next one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.session import durable

ROUNDS = 50
DEPTH = 1


@dataclass(frozen=True)
class Boosted:
    """Trees with their say."""

    trees: Sequence[DecisionTreeClassificationModel]
    says: Sequence[float]

    def decide(self, rows: DataFrame, design: str = "design") -> DataFrame:
        """Add `decision` in [-1, 1]: what the trees say for class 1 less what they say for class 0."""
        names = [f"_tree{i}" for i, _ in enumerate(self.trees)]
        told = rows
        for name, tree in zip(names, self.trees, strict=True):
            tree.setFeaturesCol(design).setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("")
            told = tree.transform(told)
        terms: list[Column] = [F.lit(say) * (2 * F.col(name) - 1) for name, say in zip(names, self.says, strict=True)]
        whole = reduce(lambda a, b: a + b, terms)
        return told.withColumn("decision", whole / F.lit(sum(self.says))).drop(*names)


def fit_adaboost(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 42) -> Boosted:
    """Discrete AdaBoost over (design, y).

    The weights are a projection of the row's last weight and of what the last tree said of it; they are
    stored after each round, so that no round repeats the ones before it.  The rounds end early when a
    tree makes no error, or is no better than chance.
    """
    at = durable(rows.select("design", "y").withColumn("weight", F.lit(1.0)))
    total = at.agg(F.sum("weight")).first()[0] or 0.0
    trees, says = [], []
    for _ in range(rounds):
        base = DecisionTreeClassifier(
            featuresCol="design", labelCol="y", weightCol="weight", maxDepth=depth, minWeightFractionPerNode=0.0, seed=seed
        )
        tree = base.fit(at)
        tree.setPredictionCol("_told").setRawPredictionCol("").setProbabilityCol("")
        told = tree.transform(at).withColumn("_wrong", F.col("_told") != F.col("y"))
        missed = told.agg(F.sum(F.when(F.col("_wrong"), F.col("weight")).otherwise(0.0))).first()[0]
        error = missed / total
        if error >= 0.5:
            break
        trees.append(tree)
        if error <= 0:
            says.append(1.0)
            break
        says.append(math.log((1 - error) / error))
        # Scaled back to the number of rows, so that weights neither grow nor vanish.
        grown = (total - missed) + missed * (1 - error) / error
        raised = F.when(F.col("_wrong"), F.lit((1 - error) / error)).otherwise(F.lit(1.0))
        at = durable(told.select("design", "y", (F.col("weight") * raised * F.lit(total / grown)).alias("weight")))
    return Boosted(trees or [tree], says or [1.0])
