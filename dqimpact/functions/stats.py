"""Statistics as column expressions that survive constant columns under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positive_zero(c: Column) -> Column:
    """Turn -0.0 into 0.0."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def rounded(c: Column, digits: int) -> Column:
    return positive_zero(F.round(c, digits))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are present; null for a constant column.

    The built-in `corr` raises on constants in ANSI mode, so the ratio is taken here.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    sd_x = F.stddev_pop(F.when(both, x))
    sd_y = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sd_x * sd_y)


def weighted_pearson(x: Column, y: Column, weight: Column) -> Column:
    """Pearson correlation of pre-aggregated pairs, `weight` rows each.

    Meant for centred inputs (ranks minus their mean), where plain sums lose no digits.
    """
    n = F.sum(weight)
    sx, sy = F.sum(weight * x), F.sum(weight * y)
    cov = F.sum(weight * x * y) - sx * sy / n
    var_x = F.sum(weight * x * x) - sx * sx / n
    var_y = F.sum(weight * y * y) - sy * sy / n
    return F.try_divide(cov, F.sqrt(var_x * var_y))


def cramers_v(chi2: Column, n: Column, rows: Column, columns: Column) -> Column:
    """Bias-corrected Cramer's V; null when one side has a single level."""
    r, k = rows.cast("double"), columns.cast("double")
    phi2 = chi2 / n
    excess = F.greatest(F.lit(0.0), phi2 - F.try_divide((k - 1) * (r - 1), n - 1))
    r_fixed = r - F.try_divide((r - 1) * (r - 1), n - 1)
    k_fixed = k - F.try_divide((k - 1) * (k - 1), n - 1)
    narrow = F.least(k_fixed - 1, r_fixed - 1)
    return F.when((r > 1) & (k > 1) & (narrow > 0), F.sqrt(F.try_divide(excess, narrow)))


def yates(chi2: Column, n: Column, inverse_rows: Column, inverse_columns: Column) -> Column:
    """Continuity-corrected chi-square of a 2x2 table from the plain one.

    In a 2x2 table every cell misses its expectation by the same amount d, so
    chi2 = d^2 * n * sum(1/row) * sum(1/column), which gives d back without the cells.
    """
    d = F.sqrt(F.greatest(F.lit(0.0), chi2) / (n * inverse_rows * inverse_columns))
    kept = F.greatest(F.lit(0.0), d - F.lit(0.5))
    return kept * kept * n * inverse_rows * inverse_columns


def matthews(agree: Column, n: Column, cross: Column, left2: Column, right2: Column) -> Column:
    """Multi-class Matthews coefficient from confusion sums; 0 when a side is constant."""
    top = agree * n - cross
    bottom = F.sqrt((n * n - left2) * (n * n - right2))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def classification_scores(tp: Column, fp: Column, fn: Column, tn: Column, digits: int = 4) -> dict[str, Column]:
    """Accuracy, recall, precision and F1 of the positive class; an empty denominator gives 0."""

    def ratio(top: Column, bottom: Column) -> Column:
        value = F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))
        return F.round(value, digits)

    return {
        "Accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "Recall": ratio(tp, tp + fn),
        "Precision": ratio(tp, tp + fp),
        "F1": ratio(2 * tp, 2 * tp + fp + fn),
    }
