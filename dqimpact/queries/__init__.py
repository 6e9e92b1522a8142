"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_draw(purpose: str, column: str, key: str, suffix: str = "", seed: int = 42) -> str:
    """SQL for the keyed draw of dqimpact.functions.draw."""
    tail = f" || ':{suffix}'" if suffix else ""
    return f"('0x' || substr(md5('{seed}:{purpose}:{column}:' || {key}{tail}), 1, 8))::bigint"


def sql_share(purpose: str, column: str, key: str, seed: int = 42) -> str:
    return f"({sql_draw(purpose, column, key, '', seed)} / 4294967296.0)"


def sql_rounded(value: str, digits: int) -> str:
    """Rounded, with NaN as NULL and without a negative zero."""
    return (
        f"(case when isnan({value}) then null when round({value}, {digits}) = 0 then 0.0 "
        f"else round({value}, {digits}) end)"
    )


LEVELS_SQL = "(select unnest([0.2, 0.4, 0.6, 0.8]::double[]) as p) lv"


def groups() -> list:
    """The modules that register queries."""
    from dqimpact.queries import cleaning, correlation, exchange, injection, sensitivity, sweeps, warehouse

    return [cleaning, injection, correlation, sweeps, sensitivity, warehouse, exchange]
