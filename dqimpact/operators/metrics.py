"""Classification scores of a 0/1 target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.functions.stats import classification_scores
from dqimpact.operators.running import running_totals


def confusion(target: Column, predicted: Column) -> list[Column]:
    """Counts tp, fp, fn, tn as aggregates."""
    return [
        F.count(F.when((target == 1) & (predicted == 1), 1)).alias("tp"),
        F.count(F.when((target == 0) & (predicted == 1), 1)).alias("fp"),
        F.count(F.when((target == 1) & (predicted == 0), 1)).alias("fn"),
        F.count(F.when((target == 0) & (predicted == 0), 1)).alias("tn"),
    ]


def binary_metrics(
    df: DataFrame, target: str, predicted: str, by: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Accuracy, Recall, Precision and F1 per group, from one aggregation."""
    counts = df.groupBy(*by).agg(*confusion(F.col(target), F.col(predicted)))
    scores = classification_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), digits)
    return counts.select(*by, *[value.alias(name) for name, value in scores.items()])


def roc_auc(
    df: DataFrame, target: str, score: str, by: Sequence[str] = (), digits: int = 4, bins: int | None = None
) -> DataFrame:
    """Area under the ROC curve per group: the share of (positive, negative) pairs in right order.

    Rows are first counted per distinct score; running totals of the negatives then give the rank
    sum, with ties counted half.  A group may hold any number of scores.  `bins` cuts scores in
    [0, 1] to that many steps: a cheaper, rounded answer for very large test sets.  A group with
    one class only gives null.
    """
    s = F.col(score).cast("double")
    if bins is not None:
        s = F.floor(s * bins) / F.lit(float(bins))
    y = F.col(target)
    counts = df.groupBy(*by, s.alias("_score")).agg(
        F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y == 0, 1)).alias("_neg")
    )
    placed = running_totals(counts, by, ["_score"], {"_below": F.col("_neg")})
    right = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return placed.groupBy(*by).agg(F.round(F.try_divide(right, pairs), digits).alias("Auc"))
