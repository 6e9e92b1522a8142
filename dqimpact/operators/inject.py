"""Controlled errors as projections.

For every (error, feature) a row gets a fraction `u` from its key, and the value it would hold
when damaged.  The row is hit at level p when u < p, so a higher level damages the same rows and
more, an untouched row keeps its value, and no shuffle takes place.  Bounds, mean, deviation and
domain always come from the clean column; a missing value stays missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.functions.draw import SPAN, draw, share
from dqimpact.operators.running import ordered_domain
from dqimpact.sources.config import ROLE_SPELLINGS

NOISE, OUTLIER, MISSING, LABELS, DUPLICATE = "noise", "outlier", "missing", "labels", "duplicate"
OUTLIER_TOKEN = "__outlier__"

# Error kind -> name in the result tables.
ERROR_NAMES = {
    NOISE: "Noisy",
    OUTLIER: "Outlier",
    MISSING: "Missing",
    LABELS: "Labels",
    DUPLICATE: "DuplicatedAll",
}

Key = str | Sequence[str]


@dataclass(frozen=True)
class Level:
    """Share of damaged rows, and the label under which it is recorded."""

    share: float
    label: float


def levels(step: float | str, recorded_rounding: bool = False) -> list[Level]:
    """Levels step, 2*step, ... below 1.

    They are counted in decimals, so 0.1 gives nine levels and 0.25 is recorded as 0.25.  With
    `recorded_rounding` the step is added up in floating point and recorded to one decimal, which
    repeats labels for fine steps and may add a last level just under 1.
    """
    if recorded_rounding:
        found, at = [], float(step)
        while at < 1:
            found.append(Level(at, round(at, 1)))
            at += float(step)
        return found
    width = Decimal(str(step))
    if not 0 < width:
        raise ValueError("step must be above 0")
    count = int((1 - Decimal("1e-12")) / width)
    return [Level(float(width * i), float(width * i)) for i in range(1, count + 1)]


def hit_share(key: Key, seed: int, error: str, feature: str) -> Column:
    return share(draw(key, seed, error, feature))


@dataclass(frozen=True)
class Summary:
    """One-row summary of a clean column, as scalar subquery fields or as literals."""

    low: Column
    high: Column
    mean: Column
    sd: Column


def summarise(clean: DataFrame, feature: str) -> Summary:
    """Summary as one scalar subquery: part of the same plan, one row whatever the data size."""
    c = F.col(f"`{feature}`")
    numeric = isinstance(clean.schema[feature].dataType, T.NumericType)
    measure = c if numeric else F.lit(None).cast("double")
    packed = clean.agg(
        F.struct(
            F.min(c).alias("low"),
            F.max(c).alias("high"),
            F.avg(measure).alias("mean"),
            F.stddev_samp(measure).alias("sd"),
        ).alias("summary")
    ).scalar()
    return Summary(packed["low"], packed["high"], packed["mean"], packed["sd"])


def summarise_all(clean: DataFrame, features: Sequence[str]) -> dict[str, Summary]:
    """Summaries of many columns from one pass, as literals: one row is fetched."""
    if not features:
        return {}
    aggregates = []
    for i, feature in enumerate(features):
        c, dtype = F.col(f"`{feature}`"), clean.schema[feature].dataType
        measure = c if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
        aggregates += [F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
        aggregates += [F.avg(measure).alias(f"m{i}"), F.stddev_samp(measure).alias(f"s{i}")]
    row = clean.agg(*aggregates).first()

    def fixed(i: int, feature: str) -> Summary:
        dtype = clean.schema[feature].dataType
        return Summary(
            F.lit(row[f"l{i}"]).cast(dtype), F.lit(row[f"h{i}"]).cast(dtype), F.lit(row[f"m{i}"]), F.lit(row[f"s{i}"])
        )

    return {feature: fixed(i, feature) for i, feature in enumerate(features)}


def _shift_out(summary: Summary, h2: Column) -> Column:
    """A value three to four deviations away from the mean, on the side the draw picks."""
    reach = (F.lit(3.0) + h2 / F.lit(float(SPAN))) * summary.sd
    return F.when(h2 % 2 == 0, summary.mean + reach).otherwise(summary.mean - reach)


def needs_domain(role: str, error: str) -> bool:
    return error == NOISE and ROLE_SPELLINGS.get(role, role) in ("categoricalString", "categoricalInteger")


def needs_summary(role: str, error: str) -> bool:
    return error in (NOISE, OUTLIER) and not needs_domain(role, error)


def damaged_value(
    dtype: T.DataType,
    feature: str,
    role: str,
    error: str,
    key: Key,
    seed: int,
    summary: Summary | None = None,
    token: str = OUTLIER_TOKEN,
) -> Column:
    """What a value becomes when hit.  A missing value stays missing.

    Noise on categories is not among it: see with_drawn_category.
    """
    role = ROLE_SPELLINGS.get(role, role)
    c = F.col(f"`{feature}`")
    if error == MISSING:
        return F.lit(None).cast(dtype)
    if error == LABELS:
        return (1 - c).cast(dtype)
    h2 = draw(key, seed, error, feature, "v")
    if (error, role) == (OUTLIER, "categoricalString"):
        value = F.lit(token)
    elif (error, role) == (NOISE, "binary"):
        value = F.when(c == summary.low, summary.high).otherwise(summary.low)
    elif (error, role) == (NOISE, "discrete"):
        value = summary.low + F.pmod(h2, (summary.high - summary.low).cast("bigint") + 1)
    elif (error, role) == (NOISE, "continous"):
        value = summary.low + h2 / F.lit(float(SPAN)) * (summary.high - summary.low)
    elif (error, role) == (OUTLIER, "discrete"):
        out = _shift_out(summary, h2)
        value = F.when(h2 % 2 == 0, F.ceil(out)).otherwise(F.floor(out))
    elif (error, role) == (OUTLIER, "continous"):
        value = _shift_out(summary, h2)
    elif (error, role) == (OUTLIER, "categoricalInteger"):
        value = summary.high + 1 + F.pmod(h2, (summary.high - summary.low).cast("bigint") + 1)
    else:
        raise ValueError(f"no {error} error for {role} features")
    # A continuous error on whole numbers needs fractions; other roles keep their type.
    kept = T.DoubleType() if role == "continous" else dtype
    return F.when(c.isNotNull(), value.cast(kept))


def with_damage(
    df: DataFrame,
    clean: DataFrame,
    feature: str,
    role: str,
    error: str,
    key: Key,
    seed: int = 42,
    into: str = "_dirty",
    token: str = OUTLIER_TOKEN,
) -> DataFrame:
    """Add the column `into`: the value each row holds when hit."""
    dtype = df.schema[feature].dataType
    if needs_domain(role, error):
        return with_drawn_category(df, clean, feature, key, seed, into)
    summary = summarise(clean, feature) if needs_summary(role, error) else None
    return df.withColumn(into, damaged_value(dtype, feature, role, error, key, seed, summary, token))


def with_drawn_category(
    df: DataFrame, clean: DataFrame, feature: str, key: Key, seed: int, into: str
) -> DataFrame:
    """Another existing value, each with the same chance, for a column with any number of values.

    One of the first k-1 values in sorted order is drawn; whoever draws its own value takes the last
    one, and a column with one value keeps it.  The drawn place is looked up in a table.  Places are
    uniform, so the join has no hot key even when one value fills the column.
    """
    c = F.col(f"`{feature}`")
    domain = ordered_domain(clean, feature, "_place")
    size = domain.agg(F.greatest(F.max("_place"), F.lit(1).cast("bigint"))).scalar()
    last = clean.agg(F.max(c)).scalar()
    placed = df.withColumn("_at", F.pmod(draw(key, seed, NOISE, feature, "v"), size))
    joined = placed.join(domain.withColumnRenamed("value", "_drawn"), F.col("_at") == F.col("_place"), "left")
    other = F.when(F.col("_drawn") == c, last).otherwise(F.col("_drawn"))
    return joined.withColumn(into, F.when(c.isNotNull(), other)).drop("_at", "_place", "_drawn")


def inject(
    df: DataFrame,
    feature: str,
    role: str,
    error: str,
    level: float,
    key: Key,
    seed: int = 42,
    clean: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The table with `level` of the feature's values damaged."""
    made = with_damage(df, df if clean is None else clean, feature, role, error, key, seed, **options)
    hit = hit_share(key, seed, error, feature) < F.lit(level)
    value = F.when(hit, F.col("_dirty")).otherwise(F.col(f"`{feature}`"))
    return made.withColumn(feature, value).drop("_dirty")


def inject_levels(
    df: DataFrame,
    feature: str,
    role: str,
    error: str,
    steps: Iterable[Level],
    key: Key,
    seed: int = 42,
    clean: DataFrame | None = None,
    **options,
) -> DataFrame:
    """All levels in one plan, with a `percentage` column; hashes are taken before rows multiply."""
    made = with_damage(df, df if clean is None else clean, feature, role, error, key, seed, **options)
    made = made.withColumn("_u", hit_share(key, seed, error, feature))
    marks = F.array(*[F.struct(F.lit(s.share).alias("share"), F.lit(s.label).alias("label")) for s in steps])
    spread = made.withColumn("_level", F.explode(marks))
    value = F.when(F.col("_u") < F.col("_level.share"), F.col("_dirty")).otherwise(F.col(f"`{feature}`"))
    return (
        spread.withColumn(feature, value)
        .withColumn("percentage", F.col("_level.label"))
        .drop("_u", "_dirty", "_level")
    )


def sweep_levels(
    df: DataFrame,
    features: Sequence[tuple[str, str]],
    error: str,
    steps: Sequence[Level],
    key: Key,
    seed: int = 42,
    carry_over: bool = False,
) -> DataFrame:
    """Every level of every (feature, role) as rows tagged with `feature` and `percentage`.

    Each feature is swept on clean data.  With `carry_over` a feature is swept on top of the last
    level of the features before it.
    """
    parts, base = [], df
    for feature, role in features:
        swept = inject_levels(base, feature, role, error, steps, key, seed, clean=df)
        parts.append(swept.withColumn("feature", F.lit(feature)))
        if carry_over:
            base = inject(base, feature, role, error, steps[-1].share, key, seed, clean=df)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def wrong_labels(df: DataFrame, target: str, level: float, key: Key, seed: int = 42) -> DataFrame:
    """Flip 0/1 labels of the hit rows.

    If one class vanishes that way, the two rows with the smallest draws keep their labels.
    """
    drawn = draw(key, seed, LABELS, target)
    hit = share(drawn) < F.lit(level)
    y = F.col(f"`{target}`")
    flipped = (1 - y).cast(df.schema[target].dataType)
    noisy = F.when(hit, flipped).otherwise(y)
    vanished = df.agg(F.min(noisy) == F.max(noisy)).scalar()
    two_smallest = df.select(drawn.alias("h")).orderBy("h").limit(2).agg(F.max("h")).scalar()
    spared = vanished & (drawn <= two_smallest)
    return df.withColumn(target, F.when(hit & ~spared, flipped).otherwise(y))


def duplicate(
    df: DataFrame,
    level: float,
    key: Key,
    seed: int = 42,
    target: str | None = None,
    target_value: object = None,
) -> DataFrame:
    """Add a copy of each hit row, of all classes or of one; `is_copy` marks the copies."""
    hit = share(draw(key, seed, DUPLICATE, "row")) < F.lit(level)
    if target is not None:
        hit = hit & (F.col(f"`{target}`") == F.lit(target_value))
    times = F.when(F.coalesce(hit, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("is_copy", F.explode(times))


@dataclass(frozen=True)
class ExactCut:
    """Rows up to this draw are hit; among rows with the draw itself, those in `keys` are."""

    below: int
    keys: tuple


def exact_cut(df: DataFrame, rows: int, key: str, seed: int, error: str, feature: str) -> ExactCut:
    """The draw that splits off exactly `rows` rows.

    Two histograms of 65,536 bins (upper, then lower half of the draw) find the cut; what remains
    are the few rows that share one 32-bit draw, settled by key.
    """
    drawn = df.select(draw(key, seed, error, feature).alias("h"), F.col(key).alias("k"))

    def find(bins: DataFrame, left: int) -> tuple[int, int]:
        for row in bins.groupBy("bin").count().orderBy("bin").collect():
            if row["count"] > left:
                return row["bin"], left
            left -= row["count"]
        return SPAN, left

    upper, left = find(drawn.select(F.shiftright("h", 16).alias("bin")), rows)
    if upper == SPAN:
        return ExactCut(SPAN, ())
    inside = drawn.filter(F.shiftright("h", 16) == upper)
    lower, left = find(inside.select(F.col("h").bitwiseAND(0xFFFF).alias("bin")), left)
    below = upper * 65536 + lower
    tied = inside.filter(F.col("h") == below).orderBy("k").limit(left).collect() if left else []
    return ExactCut(below, tuple(row["k"] for row in tied))


def exact_hit(cut: ExactCut, key: str, seed: int, error: str, feature: str) -> Column:
    drawn = draw(key, seed, error, feature)
    hit = drawn < F.lit(cut.below)
    if cut.keys:
        hit = hit | ((drawn == F.lit(cut.below)) & F.col(key).isin(*cut.keys))
    return hit
