"""Error sweeps: damage the training rows level by level, fit, and score on clean test rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.functions.draw import draw
from dqimpact.functions.stats import classification_scores
from dqimpact.operators import moments as mm
from dqimpact.operators.inject import (
    DUPLICATE,
    ERROR_NAMES,
    LABELS,
    MISSING,
    Key,
    Level,
    damaged_value,
    hit_share,
    needs_domain,
    needs_summary,
    summarise_all,
    with_drawn_category,
)
from dqimpact.operators.metrics import confusion
from dqimpact.operators.running import running_totals
from dqimpact.sources.config import FeatureSpec
from dqimpact.sources.tables import EXPERIMENTS, NO_ERROR


@dataclass(frozen=True)
class Task:
    """One error on one feature (or on the labels or rows) at rising levels."""

    error: str
    feature: str
    role: str
    levels: tuple[Level, ...]
    models: tuple[str, ...]
    target_value: int | None = None


@dataclass(frozen=True)
class Cell:
    """Labels of one scored model."""

    error: str
    percentage: float
    feature: str
    code: str


def damage_columns(
    train: DataFrame, spec: FeatureSpec, tasks: Sequence[Task], key: Key, seed: int, carry_over: bool
) -> tuple[DataFrame, list[mm.Combo]]:
    """Training rows with the draw and the damaged value of every task, and how to use them."""
    on_feature = [t for t in tasks if t.error not in (LABELS, DUPLICATE)]
    summed = list(dict.fromkeys(t.feature for t in on_feature if needs_summary(t.role, t.error)))
    summaries = summarise_all(train, summed)
    clean, schema = train, train.schema
    combos, base = [], {}
    added: dict[str, Column] = {}
    kept_columns: dict[str, Column] = {}
    for number, task in enumerate(tasks):
        u, dirty = f"_u{number}", f"_d{number}"
        name = spec.target if task.error in (LABELS, DUPLICATE) else task.feature
        share = hit_share(key, seed, task.error, "row" if task.error == DUPLICATE else name)
        if task.error == DUPLICATE and task.target_value is not None:
            share = F.when(F.col(f"`{spec.target}`") == F.lit(task.target_value), share).otherwise(F.lit(1.0))
        added[u] = share
        swaps = task in on_feature
        if swaps and needs_domain(task.role, task.error):
            train = with_drawn_category(train, clean, name, key, seed, dirty)
        elif swaps:
            added[dirty] = damaged_value(
                schema[name].dataType, name, task.role, task.error, key, seed, summaries.get(name)
            )
        same_kind = dict(base.get(task.error, {})) if carry_over else {}
        combos.append(mm.Combo(task.error, name, u, dirty if swaps else None, task.levels, same_kind))
        if carry_over and swaps and task.error != MISSING:
            kept = f"_k{number}"
            last = F.col(u) < F.lit(task.levels[-1].share)
            kept_columns[kept] = F.when(last, F.col(dirty)).otherwise(F.col(f"`{name}`"))
            base.setdefault(task.error, {})[name] = kept
    train = train.withColumns(added) if added else train
    return (train.withColumns(kept_columns) if kept_columns else train), combos


def _spare_two(
    train: DataFrame, spec: FeatureSpec, design: mm.Design, key: Key, seed: int, classes: list[mm.Moments]
) -> list[mm.Moments]:
    """Give the two rows with the smallest draws their labels back after a class has vanished."""
    rows = (
        train.select(
            draw(key, seed, LABELS, spec.target).alias("h"),
            F.col(f"`{spec.target}`").cast("int").alias("y"),
            *design.clean(),
        )
        .orderBy("h")
        .limit(2)
        .collect()
    )
    for row in rows:
        one = mm.Moments.of_row(np.array([row[f"x{i}"] for i in range(design.width)]))
        classes[1 - row["y"]] = classes[1 - row["y"]] - one
        classes[row["y"]] = classes[row["y"]] + one
    return classes


def fit_moment_cells(
    train: DataFrame,
    spec: FeatureSpec,
    tasks: Sequence[Task],
    key: Key,
    models: Sequence[str],
    features: Sequence[str] | None = None,
    seed: int = 42,
    carry_over: bool = False,
) -> tuple[mm.Design, list[tuple[Cell, mm.Decision]]]:
    """Fit the clean table and every (task, level, model) from one pass over the training rows."""
    keys = [key] if isinstance(key, str) else list(key)
    used = list(spec.features if features is None else features)
    needed = list(dict.fromkeys([*keys, spec.target, *used, *(t.feature for t in tasks)]))
    train = train.select(*[F.col(f"`{c}`") for c in needed])
    design = mm.make_design(train, spec, used)
    marked, combos = damage_columns(train, spec, tasks, key, seed, carry_over)
    combos = combos or [mm.Combo(LABELS, spec.target, "_none", None, ())]
    codes = {*models, *(m for t in tasks for m in t.models)}
    products = bool(codes & mm.NEED_PRODUCTS)
    slices = mm.collect_slices(mm.slice_sums(marked, spec.target, design, combos, products), design.width, products)

    fitted = []
    clean = mm.level_moments(slices, 0, combos[0], -1, design)
    for code in models:
        fitted.append((Cell(NO_ERROR, 0.0, NO_ERROR, code), mm.fit(code, *clean, design)))
    for number, (task, combo) in enumerate(zip(tasks, combos)):
        for at, level in enumerate(task.levels):
            classes = mm.level_moments(slices, number, combo, at, design)
            if task.error == LABELS and 0.0 in (classes[0].n, classes[1].n):
                classes = _spare_two(train, spec, design, key, seed, classes)
            for code in task.models:
                cell = Cell(ERROR_NAMES[task.error], level.label, combo.feature, code)
                fitted.append((cell, mm.fit(code, *classes, design)))
    return design, fitted


def cell_labels(test: DataFrame, dataset: str, cells: Sequence[Cell], names: dict[str, str]) -> DataFrame:
    """(model, labels): as many rows as the configuration has cells."""
    schema = T.StructType([T.StructField("model", T.IntegerType(), False), *EXPERIMENTS.fields[:5]])
    rows = [(i, dataset, c.error, c.percentage, c.feature, names[c.code]) for i, c in enumerate(cells)]
    return test.sparkSession.createDataFrame(rows, schema)


def decision_counts(scored: DataFrame) -> DataFrame:
    """(model, decision, pos, neg) from (model, y, decision)."""
    return scored.groupBy("model", "decision").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg")
    )


def score_decisions(
    scored: DataFrame,
    labels: DataFrame,
    unscored: Sequence[int] = (),
    auc: bool = True,
    predicted_label_score: bool = False,
) -> DataFrame:
    """Result rows from (model, y, decision): class 1 is predicted when the decision is positive.

    With AUC everything comes from one count per distinct decision.  `predicted_label_score` ranks
    by the confidence in whichever label was predicted, instead of by the chance of class 1.
    """
    if auc:
        return score_counts(decision_counts(scored), labels, unscored, predicted_label_score)
    sums = scored.groupBy("model").agg(
        *confusion(F.col("y"), (F.col("decision") > 0).cast("int")), F.lit(None).cast("double").alias("auc")
    )
    return _result_rows(sums, labels)


def score_counts(
    counts: DataFrame, labels: DataFrame, unscored: Sequence[int] = (), predicted_label_score: bool = False
) -> DataFrame:
    """Result rows from (model, decision, pos, neg): one pass of running totals serves all models.

    The area under the curve is the share of (positive, negative) pairs in right order, ties half.
    """
    rank = F.abs("decision") if predicted_label_score else F.col("decision")
    counts = counts.withColumn("rank", rank)
    if predicted_label_score:
        below = running_totals(
            counts.groupBy("model", "rank").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn")),
            ["model"], ["rank"], {"below": F.col("rn")},
        )
        area = below.groupBy("model").agg(_area("rp", "rn").alias("auc"))
        sums = counts.groupBy("model").agg(*_summed_confusion()).join(F.broadcast(area), "model")
    else:
        placed = running_totals(counts, ["model"], ["rank"], {"below": F.col("neg")})
        sums = placed.groupBy("model").agg(*_summed_confusion(), _area("pos", "neg").alias("auc"))
    if unscored:
        sums = sums.withColumn("auc", F.when(~F.col("model").isin(*unscored), F.col("auc")))
    return _result_rows(sums, labels)


def _result_rows(sums: DataFrame, labels: DataFrame) -> DataFrame:
    scores = classification_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return sums.join(F.broadcast(labels), "model").select(
        *EXPERIMENTS.names[:5],
        scores["Accuracy"].alias("Accuracy"),
        F.round("auc", 4).alias("Auc"),
        scores["Recall"].alias("Recall"),
        scores["Precision"].alias("Precision"),
        scores["F1"].alias("F1"),
    )


def _summed_confusion() -> list[Column]:
    positive = F.col("decision") > 0
    return [
        F.sum(F.when(positive, F.col("pos")).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(positive, F.col("neg")).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(~positive, F.col("pos")).otherwise(F.lit(0))).alias("fn"),
        F.sum(F.when(~positive, F.col("neg")).otherwise(F.lit(0))).alias("tn"),
    ]


def _area(pos: str, neg: str) -> Column:
    right = F.sum(F.col(pos).cast("double") * (F.col("below") + F.col(neg) / 2))
    return F.try_divide(right, F.sum(pos).cast("double") * F.sum(neg))


def moment_sweep(
    train: DataFrame,
    test: DataFrame,
    spec: FeatureSpec,
    tasks: Sequence[Task],
    key: Key,
    dataset: str,
    models: Sequence[str],
    features: Sequence[str] | None = None,
    seed: int = 42,
    carry_over: bool = False,
    auc: bool = True,
    predicted_label_score: bool = False,
) -> DataFrame:
    """Result rows of all cells of the sum-based models."""
    design, fitted = fit_moment_cells(train, spec, tasks, key, models, features, seed, carry_over)
    cells = [cell for cell, _ in fitted]
    target = F.col(f"`{spec.target}`").cast("int").alias("y")
    clean_test = test.filter(F.col(f"`{spec.target}`").isNotNull())
    scored = mm.decide(clean_test, [target], design, [(i, d) for i, (_, d) in enumerate(fitted)])
    names = {code: name for code, (name, _) in mm.FITS.items()}
    unscored = [i for i, cell in enumerate(cells) if cell.code in mm.WITHOUT_SCORE]
    return score_decisions(scored, cell_labels(test, dataset, cells, names), unscored, auc, predicted_label_score)
