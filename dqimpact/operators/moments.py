"""Classifiers that are functions of counts, sums and products.

Naive Bayes, discriminant analysis, ridge and the majority rule need only the number of rows, the
sums and the products of the design columns per class.  Hits at a lower level are hits at every
higher one, so a row is summed once into the slice between two levels, in its clean and in its
damaged form; the sums of any level are then sums of slices.  All errors, features, levels and
models of an experiment come from one pass over the training rows, without copying a row per
level.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.operators.encode import category_lists
from dqimpact.operators.inject import DUPLICATE, LABELS, MISSING, Level
from dqimpact.sources.config import FeatureSpec

CLEAN, DIRTY = 0, 1
MAX_DESIGN = 300


@dataclass(frozen=True)
class Design:
    """Numeric columns the models see, each standardised by clean training statistics."""

    columns: tuple[tuple[str, object], ...]  # (feature, category or None)
    centre: dict[str, float]
    spread: dict[str, float]

    @property
    def width(self) -> int:
        return len(self.columns)

    def places(self, feature: str) -> list[int]:
        return [i for i, (name, _) in enumerate(self.columns) if name == feature]

    def numeric(self, feature: str) -> bool:
        return any(name == feature and category is None for name, category in self.columns)

    def scale(self, i: int) -> float:
        name, category = self.columns[i]
        return self.spread[name] if category is None else 1.0

    def value(self, i: int, feature_column: str) -> str:
        """SQL text of design column i, read from the column that holds its feature.

        A gap in the clean data reads as the clean mean (zero here), or as no category.
        """
        name, category = self.columns[i]
        if category is not None:
            return f"if(`{feature_column}` <=> {text_literal(category)}, 1D, 0D)"
        centre, spread = self.centre[name], self.spread[name]
        return f"coalesce((cast(`{feature_column}` as double) - ({centre!r}D)) / {spread!r}D, 0D)"

    def clean(self) -> list[Column]:
        """Columns x0, x1, ... of a table that holds the features under their own names."""
        return [F.expr(self.value(i, name)).alias(f"x{i}") for i, (name, _) in enumerate(self.columns)]


def text_literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def make_design(train: DataFrame, spec: FeatureSpec, features: Sequence[str] | None = None) -> Design:
    """Plan the design columns from the clean training rows: one aggregation, plus domain lists."""
    features = list(spec.features if features is None else features)
    texts = [c for c in features if spec.role_of(c) == "categoricalString"]
    numbers = [c for c in features if c not in texts]
    centre, spread = {}, {}
    if numbers:
        row = train.agg(
            *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(numbers)],
            *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(numbers)],
        ).first()
        centre = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numbers)}
        spread = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(numbers)}
    lists = category_lists(train, texts)
    columns: list[tuple[str, object]] = []
    for c in features:
        columns.extend([(c, v) for v in lists[c]] if c in lists else [(c, None)])
    if len(columns) > MAX_DESIGN:
        raise ValueError(f"{len(columns)} design columns are too many for moment models")
    return Design(tuple(columns), centre, spread)


@dataclass(frozen=True)
class Combo:
    """One swept error: which damaged column stands in for which feature, on which base values."""

    error: str
    feature: str
    u: str
    dirty: str | None
    levels: tuple[Level, ...]
    base: dict[str, str] = field(default_factory=dict)


def slice_sums(train: DataFrame, target: str, design: Design, combos: Sequence[Combo], products: bool) -> DataFrame:
    """(combo, slice, state, y, n, s*, p*): one row per slice, state and class of each combo.

    `train` must hold the `u` and `dirty` columns of the combos.  Slice k holds rows first hit at
    level k; the last slice holds rows never hit.  The output size depends on the configuration
    only, and the sums are combined map-side.
    """
    width = design.width
    y = f"cast(`{target}` as int)"
    versions = []
    for number, combo in enumerate(combos):
        slices = " + ".join(f"int(`{combo.u}` >= {level.share!r}D)" for level in combo.levels) or "0"
        clean = {name: combo.base.get(name, name) for name, _ in design.columns}
        dirty = {**clean, combo.feature: combo.dirty or clean.get(combo.feature, target)}
        for state, sources in ((CLEAN, clean), (DIRTY, dirty)):
            label = f"1 - {y}" if state == DIRTY and combo.error == LABELS else y
            xs = ", ".join(f"'x{i}', {design.value(i, sources[name])}" for i, (name, _) in enumerate(design.columns))
            versions.append(
                f"named_struct('combo', {number}, 'levels', {len(combo.levels)}, 'slice', {slices}, "
                f"'state', {state}, 'y', {label}, {xs})"
            )
    rows = train.filter(F.col(f"`{target}`").isNotNull()).selectExpr(f"inline(array({', '.join(versions)}))")
    rows = rows.filter(f"state = {CLEAN} or slice < levels")
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width) if products or i == j]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    return rows.groupBy("combo", "slice", "state", "y").agg(F.count(F.lit(1)).alias("n"), *sums)


@dataclass
class Moments:
    """Rows, sums and products of one class."""

    n: float
    s: np.ndarray
    p: np.ndarray

    @classmethod
    def empty(cls, width: int) -> "Moments":
        return cls(0.0, np.zeros(width), np.zeros((width, width)))

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.s + other.s, self.p + other.p)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.s - other.s, self.p - other.p)

    @classmethod
    def of_row(cls, x: np.ndarray) -> "Moments":
        return cls(1.0, x, np.outer(x, x))

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Sum of squared deviations and their products."""
        return self.p - np.outer(self.s, self.s) / self.n

    def with_constant(self, places: Sequence[int], values: np.ndarray) -> "Moments":
        """The same rows with some columns set to fixed values."""
        s, p = self.s.copy(), self.p.copy()
        for i, value in zip(places, values):
            s[i] = self.n * value
        for i, value in zip(places, values):
            p[i, :] = value * s
            p[:, i] = value * s
        return Moments(self.n, s, p)


Slices = dict[tuple[int, int, int, int], Moments]


def collect_slices(sums: DataFrame, width: int, products: bool) -> Slices:
    """Bring the slice sums to the driver: their number is set by the configuration."""
    found: Slices = {}
    for row in sums.collect():
        moments = Moments.empty(width)
        moments.n = float(row["n"])
        for i in range(width):
            moments.s[i] = row[f"s{i}"]
            for j in range(i, width):
                if products or i == j:
                    moments.p[i, j] = moments.p[j, i] = row[f"p{i}_{j}"]
        found[(row["combo"], row["slice"], row["state"], row["y"])] = moments
    return found


def level_moments(
    slices: Slices, number: int, combo: Combo, at: int, design: Design, drop_gaps: bool = False
) -> list[Moments]:
    """Per-class moments of the training rows at level index `at`; -1 is the clean table.

    Values gone missing read as the mean, or the most frequent category, of the values left; with
    `drop_gaps` their rows are left out.
    """
    classes = []
    for y in (0, 1):
        kept, made = Moments.empty(design.width), Moments.empty(design.width)
        for (c, place, state, label), moments in slices.items():
            if c != number or label != y:
                continue
            if state == CLEAN and (place > at or combo.error == DUPLICATE):
                kept = kept + moments
            elif state == DIRTY and place <= at:
                made = made + moments
        classes.append((kept, made))
    if combo.error == MISSING and at >= 0 and drop_gaps:
        return [kept for kept, _ in classes]
    if combo.error == MISSING and at >= 0:
        places = design.places(combo.feature)
        left = classes[0][0] + classes[1][0]
        if left.n == 0:
            values = np.zeros(len(places))
        elif design.numeric(combo.feature):
            values = left.mean[places]
        else:
            values = np.zeros(len(places))
            values[int(np.argmax(left.s[places]))] = 1.0
        classes = [(kept, made.with_constant(places, values)) for kept, made in classes]
    return [kept + made for kept, made in classes]


@dataclass(frozen=True)
class Decision:
    """Log-odds (or margin) of class 1: constant + weights . x + x . squares . x."""

    constant: float
    weights: np.ndarray
    squares: np.ndarray | None = None


def _log_prior(m0: Moments, m1: Moments) -> float:
    return float(np.log(m1.n) - np.log(m0.n))


def fit_dummy(m0: Moments, m1: Moments, design: Design) -> Decision:
    """The more frequent class; the smaller label on a tie."""
    constant = 1.0 if m0.n == 0 else -1.0 if m1.n == 0 else _log_prior(m0, m1)
    return Decision(constant, np.zeros(design.width))


def fit_nb(m0: Moments, m1: Moments, design: Design) -> Decision:
    """Gaussian naive Bayes; a billionth of the largest variance is added to every variance."""
    scale = np.array([design.scale(i) for i in range(design.width)])
    whole = m0 + m1
    largest = float(np.max(np.diag(whole.scatter) / whole.n * scale**2, initial=0.0))
    extra = max(1e-9 * largest, 1e-300) / scale**2
    variances = [np.maximum(np.diag(m.scatter), 0.0) / m.n + extra for m in (m0, m1)]
    constant = _log_prior(m0, m1)
    weights, squares = np.zeros(design.width), np.zeros(design.width)
    for sign, m, variance in ((-1, m0, variances[0]), (1, m1, variances[1])):
        constant += sign * float(np.sum(-0.5 * np.log(variance) - m.mean**2 / (2 * variance)))
        weights += sign * m.mean / variance
        squares -= sign / (2 * variance)
    return Decision(constant, weights, np.diag(squares))


def fit_lda(m0: Moments, m1: Moments, design: Design) -> Decision:
    """Linear discriminant analysis with the pooled covariance."""
    pooled = (m0.scatter + m1.scatter) / max(m0.n + m1.n - 2, 1.0)
    inverse = np.linalg.pinv(pooled, hermitian=True)
    weights = inverse @ (m1.mean - m0.mean)
    middle = (m1.mean + m0.mean) / 2
    return Decision(_log_prior(m0, m1) - float(middle @ weights), weights)


def fit_qda(m0: Moments, m1: Moments, design: Design) -> Decision:
    """Quadratic discriminant analysis with one covariance per class."""
    constant, weights = _log_prior(m0, m1), np.zeros(design.width)
    squares = np.zeros((design.width, design.width))
    for sign, m in ((-1, m0), (1, m1)):
        covariance = m.scatter / max(m.n - 1, 1.0)
        values = np.linalg.eigvalsh(covariance)
        values = values[values > 1e-10 * max(values.max(initial=0.0), 1e-300)]
        inverse = np.linalg.pinv(covariance, hermitian=True, rcond=1e-10)
        constant += sign * (-0.5 * float(np.sum(np.log(values))) - 0.5 * float(m.mean @ inverse @ m.mean))
        weights += sign * (inverse @ m.mean)
        squares -= sign * 0.5 * inverse
    return Decision(constant, weights, squares)


def fit_ridge(m0: Moments, m1: Moments, design: Design, penalty: float = 1.0) -> Decision:
    """Least squares on -1/+1 with a squared penalty on the unscaled weights."""
    whole = m0 + m1
    scale = np.array([design.scale(i) for i in range(design.width)])
    mean_y = (m1.n - m0.n) / whole.n
    covariance = (m1.s - m0.s) - whole.s * mean_y
    weights = np.linalg.pinv(whole.scatter + np.diag(penalty / scale**2), hermitian=True) @ covariance
    return Decision(float(mean_y - whole.mean @ weights), weights)


def fit_linear(m0: Moments, m1: Moments, design: Design) -> Decision:
    """Least squares on 0/1; the decision value is the predicted number."""
    plain = fit_ridge(m0, m1, design, penalty=0.0)
    return Decision((plain.constant + 1) / 2, plain.weights / 2)


# Config code -> class name in the result tables.
FITS: dict[str, tuple[str, Callable[[Moments, Moments, Design], Decision]]] = {
    "dummy": ("DummyClassifier", fit_dummy),
    "nb": ("GaussianNB", fit_nb),
    "lda": ("LinearDiscriminantAnalysis", fit_lda),
    "qda": ("QuadraticDiscriminantAnalysis", fit_qda),
    "ridge": ("RidgeClassifier", fit_ridge),
}
NEED_PRODUCTS = {"lda", "qda", "ridge"}
WITHOUT_SCORE = {"ridge"}


def fit(code: str, m0: Moments, m1: Moments, design: Design) -> Decision:
    if m0.n == 0 or m1.n == 0:
        return fit_dummy(m0, m1, design)
    return FITS[code][1](m0, m1, design)


def decide(test: DataFrame, keep: Sequence[Column], design: Design, decisions: Sequence[tuple[int, Decision]]) -> DataFrame:
    """(keep, model, decision): every test row under every fitted model.

    The models travel as one constant array, sized by the configuration.
    """
    width = design.width
    quadratic = [(i, j) for i in range(width) for j in range(i, width)]
    schema = "array<struct<model:int,constant:double,weights:array<double>,squares:array<double>>>"

    def packed(number: int, d: Decision) -> dict:
        squares = []
        if d.squares is not None:
            squares = [float(d.squares[i, j] + (d.squares[j, i] if i != j else 0.0)) for i, j in quadratic]
        weights = [float(w) for w in d.weights]
        return {"model": number, "constant": float(d.constant), "weights": weights, "squares": squares}

    xs = test.select(*keep, *design.clean())
    names = xs.columns[: len(xs.columns) - width]
    parts = []
    for has_squares in (False, True):
        models = [packed(n, d) for n, d in decisions if (d.squares is not None) == has_squares]
        if not models:
            continue
        terms = ["m.constant", *(f"m.weights[{i}] * x{i}" for i in range(width))]
        if has_squares:
            terms += [f"m.squares[{k}] * x{i} * x{j}" for k, (i, j) in enumerate(quadratic)]
        rows = xs.select("*", F.explode(F.from_json(F.lit(json.dumps(models)), schema)).alias("m"))
        parts.append(rows.selectExpr(*names, "m.model as model", f"{' + '.join(terms)} as decision"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
