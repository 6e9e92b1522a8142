"""How strongly a score falls as the error grows: EPC at each point, EPC of a series, trends.

EPC is minus the Pearson correlation between error percentage and score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqimpact.functions.stats import pearson, positive_zero
from dqimpact.sources.tables import NO_ERROR

SERIES = ["datasetName", "errorType", "feature", "modelName"]
METRICS = ["Accuracy", "Auc", "Recall", "Precision", "F1"]
FLAT = 0.001


def series_keys(results: DataFrame) -> DataFrame:
    """Every (model, error type) met within a feature, also those never met together."""
    seen = results.filter(F.col("feature") != NO_ERROR)
    models = seen.filter(F.col("modelName") != NO_ERROR).select("datasetName", "feature", "modelName").distinct()
    errors = seen.filter(F.col("errorType") != NO_ERROR).select("datasetName", "feature", "errorType").distinct()
    return models.join(errors, ["datasetName", "feature"]).select(*SERIES)


def series_points(results: DataFrame, values: Sequence[str]) -> DataFrame:
    """Points of every series: the error-free rows of its model, then its own rows."""
    wanted = ["percentage", *values]
    clean = results.filter(F.col("errorType") == NO_ERROR).select("datasetName", "modelName", *wanted)
    own = results.filter((F.col("errorType") != NO_ERROR) & (F.col("feature") != NO_ERROR))
    keys = series_keys(results)
    start = keys.join(clean, ["datasetName", "modelName"]).withColumn("from_clean", F.lit(1))
    return start.select(*SERIES, *wanted, "from_clean").unionByName(
        own.select(*SERIES, *wanted, F.lit(0).alias("from_clean"))
    )


def _minus_pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    var_x, var_y = sxx - sx * sx / n, syy - sy * sy / n
    moving = (var_x > 0) & (var_y > 0)
    return F.when(moving, -F.try_divide(sxy - sx * sy / n, F.sqrt(var_x * var_y)))


def _reported(value: Column, spread: Column) -> Column:
    """Four digits; 0 where undefined or where the whole series hardly moves."""
    known = F.coalesce(F.when(spread > FLAT, F.round(value, 4)), F.lit(0.0))
    return positive_zero(known)


def _sums(x: Column, y: Column) -> dict[str, Column]:
    return {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}


def _anchored(points: DataFrame, metric: str) -> DataFrame:
    """Points with x and y taken from the first point of their series.

    The shift leaves correlations alone and makes a constant prefix sum to exactly zero.  Points
    without a score are left out.
    """
    points = points.withColumn("score", F.col(metric).cast("double")).filter("score is not null")
    first = points.groupBy(*SERIES).agg(
        F.min_by(F.struct("percentage", "score"), F.struct("percentage", F.lit(1) - F.col("from_clean"), "score")).alias("first")
    )
    joined = points.join(first, SERIES)
    return joined.select(
        *points.columns,
        (F.col("percentage") - F.col("first.percentage")).alias("x"),
        (F.col("score") - F.col("first.score")).alias("y"),
    )


def _whole(points: DataFrame) -> DataFrame:
    """Sums over each whole series."""
    sums = _sums(F.col("x"), F.col("y"))
    return points.groupBy(*SERIES).agg(*[F.sum(value).alias(f"all_{name}") for name, value in sums.items()])


def _spread() -> Column:
    n, s, ss = F.col("all_n"), F.col("all_sy"), F.col("all_syy")
    return F.try_divide(ss - s * s / n, n - 1)


def epc_at(results: DataFrame, metric: str = "Accuracy") -> DataFrame:
    """EPC over each prefix of each series, from its second point on.

    A series has as many points as its experiment has levels, so a window over it is short.
    """
    points = _anchored(series_points(results, [metric]), metric)
    ordered = points.withColumn("later", 1 - F.col("from_clean"))
    prefix = Window.partitionBy(*SERIES).orderBy("percentage", "later", "score")
    prefix = prefix.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ordered.select("*", *[F.sum(v).over(prefix).alias(c) for c, v in _sums(F.col("x"), F.col("y")).items()])
    judged = running.join(_whole(points), SERIES).filter("n > 1")
    value = _minus_pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return judged.select(*SERIES, "percentage", _reported(value, _spread()).alias("epc_at"))


def epc(results: DataFrame, metric: str = "Accuracy") -> DataFrame:
    """EPC of each whole series; a series without points of its own still gets a row."""
    points = _anchored(series_points(results, [metric]), metric)
    whole = series_keys(results).join(_whole(points), SERIES, "left")
    value = _minus_pearson(*[F.col(f"all_{c}") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return whole.select(*SERIES, _reported(value, _spread()).alias("epc"))


def sensitive(at: DataFrame, least: float = 0.7) -> DataFrame:
    """Points where the score clearly follows the error; 1.0 only says that two points differ."""
    return at.filter((F.col("epc_at") >= least) & (F.col("epc_at") != 1.0)).orderBy("epc_at", *SERIES, "percentage")


def performance_trend(results: DataFrame) -> DataFrame:
    """All scores along each series, clean start included: the data behind performance charts."""
    return series_points(results, METRICS).drop("from_clean")


def epc_trend(at: DataFrame, chosen: DataFrame) -> DataFrame:
    """EPC along the series that occur in `chosen`: the data behind EPC charts."""
    return at.join(chosen.select(*SERIES).distinct(), SERIES, "left_semi").select(*SERIES, "percentage", "epc_at")


def epc_all_metrics(results: DataFrame) -> DataFrame:
    """EPC of each series for each score, as (metric, series, epc), in one pass over the points."""
    points = series_points(results, METRICS)
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in METRICS])
    long = points.select(*SERIES, "percentage", F.inline(scores)).filter("score is not null")
    keys = ["metric", *SERIES]
    sums = long.groupBy(*keys).agg(
        pearson("percentage", "score").alias("corr"), F.var_samp("score").alias("spread")
    )
    wanted = series_keys(results).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    return wanted.join(sums, keys, "left").select(*keys, _reported(-F.col("corr"), F.col("spread")).alias("epc"))
