"""Association between features and a target, and between features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.functions.stats import cramers_v, matthews, pearson, weighted_pearson, yates
from dqimpact.operators.clean import drop_incomplete
from dqimpact.operators.running import running_totals
from dqimpact.sources.config import FeatureSpec

POINT_BISERIAL, CRAMERS_V, MATTHEWS = "Point-biserial", "Cramér's V", "Matthews Correlation Coefficient"
SPEARMAN, ANOVA, PHI = "Spearman", "ANOVA", "Phi Coefficient"
RELEVANT = 0.5

# Role -> name in correlation results.
ROLE_TITLES = {
    "continous": "Continuous",
    "discrete": "Discrete",
    "categoricalString": "CategoricalString",
    "categoricalInteger": "CategoricalInt",
    "binary": "Binary",
}


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every combination seen; long form, so the number of levels is free."""
    return df.select(a, b).na.drop().groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def _pair_sums(cells: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """chi2 and the numbers of rows, levels and inverse margins for each table in `cells`.

    Only seen cells are needed: all expectations of a table add up to n, so the unseen ones
    contribute n minus the expectations of the seen ones.  The margins are joined, not windowed,
    so that adaptive execution can split a level that holds most of the cells.
    """
    by = list(by)
    rows = cells.groupBy(*by, a).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(*by, b).agg(F.sum("n").alias("column_n"))
    sides = rows.groupBy(*by).agg(
        F.sum("row_n").alias("n_rows"),
        F.count(F.lit(1)).alias("row_levels"),
        F.sum(1 / F.col("row_n")).alias("row_inverse"),
    )
    other = columns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("column_levels"), F.sum(1 / F.col("column_n")).alias("column_inverse")
    )
    # One row for each table: as many as there are pairs of columns.
    sides, other = F.broadcast(sides), F.broadcast(other)
    joined = cells.join(rows, [*by, a]).join(columns, [*by, b]).join(sides, by)
    expected = F.col("row_n") * F.col("column_n") / F.col("n_rows")
    gap = F.col("n") - expected
    summed = joined.groupBy(*by).agg(
        F.sum(gap * gap / expected).alias("seen_chi2"), F.sum(expected).alias("seen_expected")
    )
    both = summed.join(sides, by).join(other, by)
    plain = F.col("seen_chi2") + (F.col("n_rows") - F.col("seen_expected"))
    is_2x2 = (F.col("row_levels") == 2) & (F.col("column_levels") == 2)
    fixed = yates(plain, F.col("n_rows"), F.col("row_inverse"), F.col("column_inverse"))
    one_level = (F.col("row_levels") == 1) | (F.col("column_levels") == 1)
    return both.withColumn(
        "chi2", F.when(one_level, F.lit(0.0)).when(is_2x2, fixed).otherwise(F.greatest(F.lit(0.0), plain))
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 (continuity-corrected for a 2x2 table), n, row_levels, column_levels."""
    cells = contingency(df, a, b).select(
        F.lit(0).alias("table"), quoted(a).alias("a"), quoted(b).alias("b"), "n"
    )
    sums = _pair_sums(cells, ["table"], "a", "b")
    return sums.select("chi2", F.col("n_rows").alias("n"), "row_levels", "column_levels")


def cramers_v_of(df: DataFrame, a: str, b: str) -> DataFrame:
    v = cramers_v(F.col("chi2"), F.col("n"), F.col("row_levels"), F.col("column_levels"))
    return chi_square(df, a, b).select(v.alias("cramers_v"))


NO_VALUE = "None"


def _text(schema: T.StructType, column: str) -> Column:
    """Numbers as double text, so that 1 and 1.0 are one level."""
    c = quoted(column)
    return c.cast("double").cast("string") if isinstance(schema[column].dataType, T.NumericType) else c.cast("string")


def _level(schema: T.StructType, column: str) -> Column:
    """Like _text, with a missing text as a level of its own; a missing number stays missing."""
    text = _text(schema, column)
    return text if isinstance(schema[column].dataType, T.NumericType) else F.coalesce(text, F.lit(NO_VALUE))


def _against_target(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, Feature, value, y, n): one long table for all listed features, one shuffle."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("Feature"), _text(df.schema, c).alias("value")) for c in columns]
    )
    long = df.select(*by, _text(df.schema, target).alias("y"), F.inline(cells))
    long = long.filter(F.col("value").isNotNull() & F.col("y").isNotNull())
    return long.groupBy(*by, "Feature", "value", "y").agg(F.count(F.lit(1)).alias("n"))


def _categorical_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cramer's V and, where both sides have two levels, the Matthews coefficient of each feature.

    The Matthews coefficient compares levels with classes of the same name.
    """
    keys = [*by, "Feature"]
    sums = _pair_sums(cells, keys, "value", "y")
    rows = cells.groupBy(*keys, "value").agg(F.sum("n").cast("double").alias("row_n"))
    classes = cells.groupBy(*keys, "y").agg(F.sum("n").cast("double").alias("class_n"))
    left2 = rows.groupBy(*keys).agg(F.sum(F.col("row_n") * F.col("row_n")).alias("left2"))
    right2 = classes.groupBy(*keys).agg(F.sum(F.col("class_n") * F.col("class_n")).alias("right2"))
    same = cells.groupBy(*keys).agg(F.sum(F.when(F.col("value") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"))
    met = rows.join(classes.withColumnRenamed("y", "value"), [*keys, "value"])
    cross = met.groupBy(*keys).agg(F.sum(F.col("row_n") * F.col("class_n")).alias("cross"))
    whole = sums.join(left2, keys).join(right2, keys).join(same, keys).join(cross, keys, "left")
    n = F.col("n_rows").cast("double")
    coefficient = matthews(
        F.col("agree").cast("double"), n, F.coalesce("cross", F.lit(0.0)), F.col("left2"), F.col("right2")
    )
    two = (F.col("row_levels") == 2) & (F.col("column_levels") <= 2)
    return whole.select(
        *keys,
        F.col("row_levels").alias("levels"),
        cramers_v(F.col("chi2"), n, F.col("row_levels"), F.col("column_levels")).alias("v"),
        F.when(two, coefficient).alias("mcc"),
    )


def _role_columns(df: DataFrame, spec: FeatureSpec) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical and binary features, each listed once and in lookup order."""
    seen: set[str] = set()

    def fresh(*roles: str) -> list[str]:
        names = [c for role in roles for c in spec.role(role) if c in df.columns and c not in seen]
        names = list(dict.fromkeys(names))
        seen.update(names)
        return names

    return fresh("continous", "discrete"), fresh("categoricalString", "categoricalInteger"), fresh("binary")


def target_correlations(
    df: DataFrame, spec: FeatureSpec, by: Sequence[str] = (), threshold: float = RELEVANT
) -> DataFrame:
    """(by, Feature, Role, Type, Correlation, relevant) for every feature that has a defined value.

    The measure follows the role; rows with a gap in any column are left out first.  All numeric
    features share one aggregation and all others one long count.
    """
    data = drop_incomplete(df)
    numeric, categorical, binary = _role_columns(df, spec)
    parts = []
    if numeric:
        sums = data.groupBy(*by).agg(
            *[pearson(quoted(c), quoted(spec.target)).alias(f"c{i}") for i, c in enumerate(numeric)]
        )
        rows = [
            F.struct(
                F.lit(c).alias("Feature"), F.lit(POINT_BISERIAL).alias("Type"), F.col(f"c{i}").alias("Correlation")
            )
            for i, c in enumerate(numeric)
        ]
        parts.append(sums.select(*by, F.inline(F.array(*rows))))
    if categorical or binary:
        scores = _categorical_scores(_against_target(data, [*categorical, *binary], spec.target, by), by)
        is_binary = F.col("Feature").isin(*binary) if binary else F.lit(False)
        parts.append(
            scores.select(
                *by,
                "Feature",
                F.when(is_binary, F.lit(MATTHEWS)).otherwise(F.lit(CRAMERS_V)).alias("Type"),
                F.when(is_binary, F.col("mcc")).otherwise(F.col("v")).alias("Correlation"),
            )
        )
    whole = reduce(DataFrame.unionByName, parts).filter("Correlation is not null")
    titles = F.create_map(*[F.lit(x) for c in spec.features for x in (c, ROLE_TITLES[spec.role_of(c)])])
    return whole.select(
        *by,
        "Feature",
        F.element_at(titles, F.col("Feature")).alias("Role"),
        "Type",
        "Correlation",
        (F.abs("Correlation") >= threshold).alias("relevant"),
    )


def correlation_after_error(
    damaged: DataFrame, feature: str, role: str, target: str, by: Sequence[str] = ("percentage",)
) -> DataFrame:
    """(by, Feature, Correlation, Correlation Type) of one feature at every injected level."""
    spec = FeatureSpec(target, {role: (feature,)})
    found = target_correlations(damaged.select(*by, feature, target), spec, by)
    return found.select(*by, "Feature", "Correlation", F.col("Type").alias("Correlation Type"))


def numeric_target_correlations(df: DataFrame, target: str) -> DataFrame:
    """(Feature, Correlation) of every numeric column with the target, the target included."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    sums = df.agg(*[pearson(quoted(c), quoted(target)).alias(f"c{i}") for i, c in enumerate(numeric)])
    rows = [F.struct(F.lit(c).alias("Feature"), F.col(f"c{i}").alias("Correlation")) for i, c in enumerate(numeric)]
    return sums.select(F.inline(F.array(*rows))).filter("Correlation is not null")


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(Feature, value, n, rank, total): average rank of every distinct value, for all columns.

    Ranks rest on counts per distinct value, so repeated values never travel, and on running
    totals that no single task has to hold.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("Feature"), quoted(c).cast("double").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(cells))
        .filter("value is not null")
        .groupBy("Feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counts, ["Feature"], ["value"], {"below": F.col("n")})
    return placed.withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(Feature1, Feature2, Correlation); a gap in either column leaves the pair undefined.

    Each column's ranks join back on its value.  The rank tables grow with the number of distinct
    values, so the joins carry no hint: adaptive execution broadcasts short tables and splits hot
    values of long ones.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    ranks = average_ranks(df, columns)
    numbers = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = numbers.groupBy(*numbers.columns).agg(F.count(F.lit(1)).alias("_n"))
    for i, c in enumerate(columns):
        of_column = ranks.filter(F.col("Feature") == c).select(
            F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}")
        )
        rows = rows.join(of_column, F.col(f"x{i}") == F.col(f"v{i}"), "left").drop(f"v{i}")
    # Ranks are centred on the middle of the column, which keeps the sums exact in practice.
    middle = (df.agg(F.count(F.lit(1))).scalar() + 1) / 2
    at = {c: i for i, c in enumerate(columns)}
    sums, output = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"r{at[a]}") - middle, F.col(f"r{at[b]}") - middle
        gaps = F.count(F.when(x.isNull() | y.isNull(), 1))
        sums.append(F.when(gaps == 0, weighted_pearson(x, y, F.col("_n"))).alias(f"s{i}"))
        output.append(
            F.struct(F.lit(a).alias("Feature1"), F.lit(b).alias("Feature2"), F.col(f"s{i}").alias("Correlation"))
        )
    return rows.agg(*sums).select(F.inline(F.array(*output)))


def phi_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    sums, output = [], []
    for i, (a, b) in enumerate(pairs):
        gaps = F.count(F.when(quoted(a).isNull() | quoted(b).isNull(), 1))
        sums.append(F.when(gaps == 0, pearson(quoted(a), quoted(b))).alias(f"s{i}"))
        output.append(
            F.struct(F.lit(a).alias("Feature1"), F.lit(b).alias("Feature2"), F.col(f"s{i}").alias("Correlation"))
        )
    return df.agg(*sums).select(F.inline(F.array(*output)))


def cramers_v_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("Feature1"),
                F.lit(b).alias("Feature2"),
                _level(df.schema, a).alias("a"),
                _level(df.schema, b).alias("b"),
            )
            for a, b in pairs
        ]
    )
    keys = ["Feature1", "Feature2"]
    counts = df.select(F.inline(cells)).na.drop().groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    sums = _pair_sums(counts, keys, "a", "b")
    v = cramers_v(F.col("chi2"), F.col("n_rows"), F.col("row_levels"), F.col("column_levels"))
    return sums.select(*keys, v.alias("Correlation"))


def group_mean_variance(df: DataFrame, pairs: Sequence[tuple[str, str]], categories: set[str]) -> DataFrame:
    """Sample variance of the numeric column's group means, for pairs of a number and a category."""
    cells = []
    for a, b in pairs:
        number, category = (b, a) if a in categories else (a, b)
        cells.append(
            F.struct(
                F.lit(a).alias("Feature1"),
                F.lit(b).alias("Feature2"),
                quoted(number).cast("double").alias("x"),
                _level(df.schema, category).alias("g"),
            )
        )
    keys = ["Feature1", "Feature2"]
    means = (
        df.select(F.inline(F.array(*cells)))
        .filter("g is not null")
        .groupBy(*keys, "g")
        .agg(F.avg("x").alias("m"))
    )
    return means.groupBy(*keys).agg(F.var_samp("m").alias("Correlation"))


def measure_for(spec: FeatureSpec, a: str, b: str) -> str | None:
    """Which measure suits a pair, by the roles of both columns."""
    numeric = {*spec.role("continous"), *spec.role("discrete")}
    categories = {*spec.role("categoricalString"), *spec.role("categoricalInteger")}
    binary = set(spec.role("binary"))
    kinds = {"numeric": numeric, "category": categories, "binary": binary}
    kind = {c: next((k for k, names in kinds.items() if c in names), None) for c in (a, b)}
    # Measure by the kinds of the two columns.
    table = {
        frozenset(["numeric"]): SPEARMAN,
        frozenset(["category"]): CRAMERS_V,
        frozenset(["numeric", "category"]): ANOVA,
        frozenset(["binary"]): PHI,
        frozenset(["binary", "numeric"]): SPEARMAN,
        frozenset(["binary", "category"]): CRAMERS_V,
    }
    return table.get(frozenset(kind.values()))


def pairwise_correlations(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(Feature1, Feature2, Type, Correlation) for every pair of features with a role.

    The schema decides the measure of each pair; pairs with the same measure share their work.
    """
    order = ["continous", "discrete", "categoricalString", "categoricalInteger", "binary"]
    columns = [c for role in order for c in spec.role(role) if c in df.columns]
    by_measure: dict[str, list[tuple[str, str]]] = {}
    for a, b in combinations(columns, 2):
        measure = measure_for(spec, a, b)
        if measure is not None:
            by_measure.setdefault(measure, []).append((a, b))
    categories = {*spec.role("categoricalString"), *spec.role("categoricalInteger")}
    parts = []
    for measure, pairs in by_measure.items():
        if measure == SPEARMAN:
            part = spearman_pairs(df, pairs)
        elif measure == PHI:
            part = phi_pairs(df, pairs)
        elif measure == CRAMERS_V:
            part = cramers_v_pairs(df, pairs)
        else:
            part = group_mean_variance(df, pairs, categories)
        parts.append(part.withColumn("Type", F.lit(measure)))
    return reduce(DataFrame.unionByName, parts).select("Feature1", "Feature2", "Type", "Correlation")


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """For each column the smallest value of each bin but the first, in order: fewer than `bins` numbers.

    A value lies in bin floor(bins * rows below it / rows), so bins hold equal shares of the rows as far as
    ties allow.  Counts of distinct values are placed by running totals; only the edges come to the driver.
    """
    placed = average_ranks(df, columns)
    totals = placed.groupBy("Feature").agg(F.sum("n").alias("rows"))
    bin_of = F.floor(F.col("below") * bins / F.col("rows"))
    at = placed.join(F.broadcast(totals), "Feature").groupBy("Feature", bin_of.alias("bin")).agg(F.min("value").alias("low"))
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for row in at.filter("bin > 0").collect():
        edges[row["Feature"]].append(row["low"])
    return {c: sorted(lows) for c, lows in edges.items()}


def mutual_information(
    df: DataFrame,
    spec: FeatureSpec,
    bins: int = 10,
    equal_width: bool = False,
) -> DataFrame:
    """(Feature, Score) with Score > 0: plug-in mutual information in nats with the target.

    Values of continuous features are put into bins first: equal shares of the rows, by exact counts of
    the rows below each value (equal values share a bin), or equal widths.
    """
    continuous = set(spec.role("continous"))
    columns = [c for role in ("discrete", "continous", "binary", "categoricalString", "categoricalInteger")
               for c in spec.role(role)]
    numbered = [(i, c) for i, c in enumerate(columns) if c in continuous]
    if not equal_width:
        edges = quantile_edges(df, [c for _, c in numbered], bins) if numbered else {}
    elif numbered:
        ends = [F.array(F.min(quoted(c)), F.max(quoted(c))).cast("array<double>").alias(f"e{i}") for i, c in numbered]
        found = df.agg(*ends).first()
        edges = {c: found[f"e{i}"] for i, c in numbered}

    def level(i: int, c: str) -> Column:
        if c not in continuous:
            return _text(df.schema, c)
        x, marks = quoted(c).cast("double"), edges[c]
        if equal_width:
            low, high = marks
            width = high - low
            place = F.lit(0) if not width else F.least(F.floor((x - F.lit(low)) / F.lit(width) * bins), F.lit(bins - 1))
            return F.when(x.isNotNull(), place.cast("string"))
        above = reduce(lambda a, b: a + b, [F.when(x >= F.lit(m), 1).otherwise(0) for m in marks], F.lit(0))
        return F.when(x.isNotNull(), above.cast("string"))

    cells = F.array(
        *[F.struct(F.lit(c).alias("Feature"), level(i, c).alias("value")) for i, c in enumerate(columns)]
    )
    y = quoted(spec.target)
    counts = (
        df.select(y.cast("string").alias("_y"), F.inline(cells))
        .na.drop()
        .groupBy("Feature", "value", "_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Only the totals have a known size, a row for each feature; a target may have any number of values.
    values = counts.groupBy("Feature", "value").agg(F.sum("n").alias("value_n"))
    classes = counts.groupBy("Feature", "_y").agg(F.sum("n").alias("class_n"))
    totals = classes.groupBy("Feature").agg(F.sum("class_n").alias("total"))
    joined = (
        counts.join(values, ["Feature", "value"])
        .join(classes, ["Feature", "_y"])
        .join(F.broadcast(totals), ["Feature"])
    )
    n, v, k, total = (F.col(c).cast("double") for c in ("n", "value_n", "class_n", "total"))
    score = F.sum(n / total * F.log(n * total / (v * k)))
    return joined.groupBy("Feature").agg(score.alias("Score")).filter("Score > 0")
