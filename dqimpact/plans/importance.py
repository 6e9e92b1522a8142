"""How much a model's score falls when one feature's values are dealt anew among the scored rows.

All repeats and features come from one plan.  Every row has a place in the order of the keys; for each
repeat every row also has a place in the order of a draw.  The row at a place then takes one feature's
value from the row with the same place in the drawn order.  A repeat uses one order for all features.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.functions.draw import draw
from dqimpact.functions.stats import rounded
from dqimpact.operators import moments as mm
from dqimpact.operators.encode import in_test
from dqimpact.operators.inject import ERROR_NAMES, MISSING
from dqimpact.operators.running import running_totals
from dqimpact.plans.sweep import Task, damage_columns
from dqimpact.sources.config import FeatureSpec

REPEATS = 10
TOP = 10
SEED = 42


def dealt_anew(rows: DataFrame, key: str, by: Sequence[str] = (), repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """by, repeat, own, donor: each row of a group with the row whose values it takes, for each repeat.

    `own` and `donor` are structs of all columns.
    """
    whole = rows.select(*by, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("_key"))
    one = {"_place": F.lit(1).cast("long")}
    placed = running_totals(whole, by, ["_key"], one).select(*by, "_place", F.col("row").alias("own"))
    orders = F.array(*[F.struct(F.lit(k).alias("repeat"), draw("_key", seed + k, "shuffle", "row").alias("_draw")) for k in range(repeats)])
    drawn = whole.select(*by, "row", "_key", F.inline(orders))
    donors = running_totals(drawn, [*by, "repeat"], ["_draw", "_key"], one)
    donors = donors.select(*by, "repeat", "_place", F.col("row").alias("donor"))
    return placed.join(donors, [*by, "_place"]).select(*by, "repeat", "own", "donor")


def label_importance(
    shaped: PipelineModel, model, test: DataFrame, features: Sequence[str], key: str, repeats: int = REPEATS, seed: int = SEED
) -> DataFrame:
    """(feature, repeat, importance): by how much the accuracy of a fitted classifier falls.

    `test` holds the key, the features and y.
    """
    pairs = dealt_anew(test, key, (), repeats, seed)
    # The rows as they are stand beside the changed ones under no feature, so that one scoring serves all.
    changed = F.array(
        *[F.struct(F.lit(f).alias("feature"), *_values(features, f)) for f in features],
        F.when(F.col("repeat") == 0, F.struct(F.lit(None).cast("string").alias("feature"), *_values(features, None))),
    )
    long = pairs.select("repeat", F.col("own.y").alias("y"), F.explode(changed).alias("_v")).filter("_v is not null")
    scored = model.transform(shaped.transform(long.select("repeat", "y", "_v.*")))
    right = F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy")
    accuracies = scored.groupBy("feature", "repeat").agg(right)
    whole = accuracies.filter("feature is null").select(F.col("accuracy").alias("whole"))
    joined = accuracies.filter("feature is not null").join(F.broadcast(whole))
    return joined.select("feature", "repeat", rounded(F.col("whole") - F.col("accuracy"), 6).alias("importance"))


def _values(features: Sequence[str], taken: str | None) -> list[Column]:
    return [F.col("donor" if f == taken else "own")[f].alias(f) for f in features]


def stability(importances: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by, mean, sd, variation) of importances over repeats."""
    made = importances.groupBy(*by).agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("sd"))
    return made.withColumn("variation", F.try_divide("sd", "mean"))


def importance_along_errors(
    df: DataFrame, spec: FeatureSpec, tasks: Sequence[Task], key: str, repeats: int = REPEATS, seed: int = SEED
) -> DataFrame:
    """errorType, percentage, feature, name, importance: what each feature means to a linear model on damaged rows.

    `feature` is the damaged one, `name` the one whose values are dealt anew.  Rows with a gap are left
    out, also those whose value went missing.  Least squares on 0/1 are fitted to four fifths of the rows
    of each level, all levels from one pass; importance is the mean fall of R squared on the others.
    """
    used = spec.features
    whole = df.select(key, spec.target, *used).na.drop()
    marked, combos = damage_columns(whole, spec, tasks, key, seed, False)
    held = in_test(key, seed=seed)
    train = marked.filter(~held)
    design = mm.make_design(train, spec, used)
    slices = mm.collect_slices(mm.slice_sums(train, spec.target, design, combos, True), design.width, True)
    cells, versions = [], []
    for number, (task, combo) in enumerate(zip(tasks, combos, strict=True)):
        for at, level in enumerate(task.levels):
            model = mm.fit_linear(*mm.level_moments(slices, number, combo, at, design, drop_gaps=True), design)
            hit = f"`{combo.u}` < {level.share!r}D"
            xs = []
            for i, (name, _) in enumerate(design.columns):
                clean = design.value(i, name)
                if name == combo.feature and combo.dirty:
                    xs.append(f"if({hit}, {design.value(i, combo.dirty)}, {clean})")
                else:
                    xs.append(clean)
            label = f"if({hit}, 1 - `{spec.target}`, `{spec.target}`)" if task.error == "labels" else f"`{spec.target}`"
            kept = f"not ({hit})" if task.error == MISSING else "true"
            versions.append(
                f"named_struct('cell', {len(cells)}, 'kept', {kept}, 'y', cast({label} as double), 'x', array({', '.join(xs)}))"
            )
            cells.append((len(cells), ERROR_NAMES[task.error], level.label, combo.feature, model))
    if not cells:
        raise ValueError("no error levels to measure")
    long = marked.filter(held).selectExpr(f"`{key}`", f"inline(array({', '.join(versions)}))").filter("kept").drop("kept")
    pairs = dealt_anew(long, key, ["cell"], repeats, seed)

    schema = "cell int, errorType string, percentage double, feature string, constant double, weights array<double>"
    rows = [(*cell[:4], float(cell[4].constant), [float(w) for w in cell[4].weights]) for cell in cells]
    models = df.sparkSession.createDataFrame(rows, schema)
    told = pairs.join(F.broadcast(models), "cell")

    def predicted(taken: str | None) -> Column:
        terms = [
            F.col("weights")[i] * F.col("donor" if name == taken else "own")["x"][i] for i, (name, _) in enumerate(design.columns)
        ]
        return reduce(lambda a, b: a + b, terms, F.col("constant"))

    def missed(taken: str | None) -> Column:
        gap = F.col("own.y") - predicted(taken)
        return F.sum(gap * gap)

    keys = ["errorType", "percentage", "feature", "repeat"]
    sums = told.groupBy(*keys).agg(
        (F.var_pop("own.y") * F.count(F.lit(1))).alias("spread"), missed(None).alias("base"),
        *[missed(f).alias(f"sse{i}") for i, f in enumerate(used)],
    )
    falls = F.array(
        *[
            F.struct(F.lit(f).alias("name"), F.try_divide(F.col(f"sse{i}") - F.col("base"), F.col("spread")).alias("fall"))
            for i, f in enumerate(used)
        ]
    )
    each = sums.select(*keys, F.inline(falls))
    return each.groupBy("errorType", "percentage", "feature", "name").agg(rounded(F.avg("fall"), 6).alias("importance"))


def top(importances: DataFrame, by: str, count: int = TOP) -> DataFrame:
    """(by, feature, importance): the features of the largest mean importance of each model."""
    means = importances.groupBy(by, "feature").agg(rounded(F.avg("importance"), 6).alias("importance"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("low"), "feature"))), 1, count)
    # A model has as many rows here as it has features.
    return means.groupBy(by).agg(best.alias("best")).select(by, F.explode("best").alias("b")).select(
        by, "b.feature", (-F.col("b.low")).alias("importance")
    )

