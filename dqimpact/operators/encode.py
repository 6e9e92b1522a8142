"""Label encoding, one-hot encoding, standardising and the held-out split."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.functions.draw import draw, share
from dqimpact.operators.running import ordered_domain


def label_encode(df: DataFrame, column: str, encoded: str, null_text: str | None = None) -> DataFrame:
    """Replace each value by its 0-based place among the sorted distinct values.

    Nulls stay null, or count as the value `null_text`.  The code table grows with the data, so
    the join carries no hint: adaptive execution broadcasts a small table and splits hot values
    when both sides are shuffled.
    """
    text = F.col(column) if null_text is None else F.coalesce(F.col(column).cast("string"), F.lit(null_text))
    keyed = df.withColumn("_text", text)
    codes = ordered_domain(keyed, "_text", encoded)
    return keyed.join(codes, F.col("_text") == F.col("value"), "left").drop("_text", "value")


def _typed(dtype: T.DataType, text: str) -> object:
    if isinstance(dtype, T.IntegralType):
        return int(text)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(dtype, T.DecimalType):
        return Decimal(text)
    if isinstance(dtype, T.BooleanType):
        return text == "true"
    return text


def category_lists(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted categories per column, for one-hot encoding into as many columns.

    The lists become part of the plan; use `one_hot_places` where a column has too many values for that.
    """
    if not columns:
        return {}
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    found: dict[str, list] = {column: [] for column in columns}
    for row in df.select(F.inline(cells)).filter("value is not null").distinct().toLocalIterator():
        column = columns[row["place"]]
        found[column].append(_typed(df.schema[column].dataType, row["value"]))
    return {column: sorted(values) for column, values in found.items()}


def one_hot_places(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place): where each row has its 1 among the sorted values of the column, for any number of them."""
    return label_encode(df.select(key, column), column, "place").select(key, "place").filter("place is not null")


def indicator(column: Column, value: object) -> Column:
    return F.when(column == F.lit(value), F.lit(1.0)).otherwise(F.lit(0.0))


def one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """One 0/1 column per known category; an unknown value gives zeros; other columns pass through."""
    rest = [F.col(f"`{name}`") for name in df.columns if name not in categories]
    coded = [
        indicator(F.col(f"`{name}`"), value).alias(f"{name}_{value}")
        for name, values in categories.items()
        for value in values
    ]
    return df.select(*coded, *rest)


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; a constant column scales by 1."""
    row = df.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"{i}_mean") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"{i}_sd") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"{i}_mean"] or 0.0, row[f"{i}_sd"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply a scaling fitted on the training rows to any rows."""
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(mean)) / F.lit(sd) for c, (mean, sd) in scales.items()})


def in_test(key: str | Sequence[str], test_share: float = 0.2, seed: int = 42) -> Column:
    return share(draw(key, seed, "split", "row")) < F.lit(test_share)


def split(
    df: DataFrame, key: str | Sequence[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: no shuffle, the same rows on every run."""
    held_out = in_test(key, test_share, seed)
    return df.filter(~held_out), df.filter(held_out)
