"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATETIME_TEXT = "d-M-yyyy H:m"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def finite_or_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN and infinities into nulls."""
    wanted = set(df.columns if columns is None else columns)

    def fixed(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if field.name not in wanted or not is_floating(field.dataType):
            return c
        bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(~bad, c).alias(field.name)

    return df.select(*[fixed(field) for field in df.schema.fields])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose values (in `columns`, or in all columns) are all present and finite."""
    names = list(df.columns if columns is None else columns)
    return finite_or_null(df, names).na.drop("any", subset=names)


def feature_and_target(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Two columns, complete rows only; a gap elsewhere does not cost a row."""
    return drop_incomplete(df.select(feature, target))


def _long(df: DataFrame, measures: dict[str, dict[str, Column]], order: Sequence[str]) -> DataFrame:
    """One aggregate pass over all columns, then one output row per column."""
    aggregates = [
        value.alias(f"{i}_{name}")
        for i, per_column in enumerate(measures.values())
        for name, value in per_column.items()
    ]
    rows = [
        F.struct(F.lit(column).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in order])
        for i, column in enumerate(measures)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def datetime_profile(df: DataFrame) -> DataFrame:
    """(column, n_values, n_parsed, is_datetime): do all values of a column read as date and time?"""
    measures = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            parsed = F.try_to_timestamp(c, F.lit(DATETIME_TEXT))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parsed = c
        else:
            parsed = F.when(c.isNull(), c)
        measures[field.name] = {"n_values": F.count(c), "n_parsed": F.count(parsed)}
    profile = _long(df, measures, ["n_values", "n_parsed"])
    return profile.withColumn("is_datetime", F.col("n_values") == F.col("n_parsed"))


def spread_profile(df: DataFrame) -> DataFrame:
    """(column, n_values, has_two_values): min and max tell a constant column in one pass."""
    measures = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        measures[field.name] = {
            "n_values": F.count(c),
            "has_two_values": F.coalesce(F.min(c) != F.max(c), F.lit(False)),
        }
    return _long(df, measures, ["n_values", "has_two_values"])


def remove_datetime_columns(df: DataFrame) -> DataFrame:
    found = datetime_profile(df).filter("is_datetime").select("column").collect()
    return df.drop(*[row["column"] for row in found])


def remove_constant_columns(df: DataFrame) -> DataFrame:
    found = spread_profile(df).filter("not has_two_values").select("column").collect()
    return df.drop(*[row["column"] for row in found])


def text_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n_values, n_null, n_distinct) for every column.

    Distinct values are counted from a long (column, value) table, so a wide table costs one
    shuffle of distinct values instead of one sort per column.
    """
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value"))
            for name in df.columns
        ]
    )
    per_value = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(present, F.lit(1))).alias("n_distinct"),
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
