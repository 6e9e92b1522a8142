"""Cleaning, encoding and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.functions.stats import rounded
from dqimpact.operators import clean, encode
from dqimpact.operators.inject import inject
from dqimpact.queries import Query, sql_rounded, sql_share, table


def _gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a fifth of the values missing and the largest ones infinite."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    gappy = inject(events, "value", "continous", "missing", 0.2, "event_id")
    return gappy.withColumn("value", F.when(F.col("value") > 150, F.lit(float("inf"))).otherwise(F.col("value")))


GAPPY_SQL = f"""(select event_id, user_id, event_type,
  case when {sql_share('missing', 'value', 'event_id')} < 0.2 then null
       when value > 150 then 'infinity'::double else value end as value from events) e"""


def clean_drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_incomplete(_gappy_events(spark, folder))


def drop_missing_target(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.drop_missing_target(_gappy_events(spark, folder), "value")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def feature_and_target(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.feature_and_target(_gappy_events(spark, folder), "value", "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("value"), 4).alias("largest"))


def _orders_plus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "dd-MM-yyyy HH:mm").alias("day_text"),
        F.lit("same").alias("constant"),
    )


ORDERS_PLUS_SQL = """(select o_orderkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%d-%m-%Y %H:%M') as day_text, 'same' as "constant" from orders)"""


def constant_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.spread_profile(_orders_plus(spark, folder))


def datetime_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.datetime_profile(_orders_plus(spark, folder))


def remaining_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per remaining column after constant and date columns are gone."""
    kept = clean.remove_constant_columns(clean.remove_datetime_columns(_orders_plus(spark, folder)))
    return clean.column_counts(kept)


def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    coded = encode.label_encode(orders, "o_orderpriority", "priority_code")
    return encode.label_encode(coded, "o_custkey", "customer_code").select(
        "o_orderkey", "priority_code", "customer_code"
    )


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    train, _ = encode.split(orders, "o_orderkey")
    made = encode.one_hot(orders, encode.category_lists(train, ["o_orderstatus"]))
    return made.select("o_orderkey", *[c for c in made.columns if c != "o_orderkey"])


def one_hot_places(spark: SparkSession, folder: str) -> DataFrame:
    """A column with many values: the place of the 1 instead of a column for each value."""
    return encode.one_hot_places(table(spark, folder, "orders"), "o_orderkey", "o_custkey")


def standardize(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    train, test = encode.split(orders, "o_orderkey")
    scaled = encode.standardize(test, encode.scaling(train, ["o_totalprice"]))
    return scaled.select("o_orderkey", rounded(F.col("o_totalprice"), 6).alias("o_totalprice"))


def hash_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    part = F.when(encode.in_test("o_orderkey"), "test").otherwise("train")
    return orders.groupBy(part.alias("part"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.class_counts(table(spark, folder, "labels"), "quality")


DISTINCT_COLUMNS = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.column_counts(table(spark, folder, "lineitem").select(*DISTINCT_COLUMNS))


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return clean.distinct_values(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


QUERIES: dict[str, Query] = {
    "clean_drop_nulls": clean_drop_nulls,
    "drop_missing_target": drop_missing_target,
    "feature_and_target": feature_and_target,
    "constant_columns": constant_columns,
    "datetime_columns": datetime_columns,
    "remaining_columns": remaining_columns,
    "label_encode": label_encode,
    "one_hot": one_hot,
    "one_hot_places": one_hot_places,
    "standardize": standardize,
    "hash_split_counts": hash_split_counts,
    "class_counts": class_counts,
    "distinct_counts": distinct_counts,
    "distinct_values": distinct_values,
}

_SPLIT = sql_share("split", "row", "o_orderkey")
_PLUS_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "day_text", "constant"]


def _parsed(column: str) -> str:
    # Only text columns are tried.
    if column in ("o_orderstatus", "day_text", "constant"):
        return f"count(try_strptime(\"{column}\", '%d-%m-%Y %H:%M'))"
    return "0"


ORACLE: dict[str, str] = {
    "clean_drop_nulls": f"""select event_id, user_id, event_type, value from {GAPPY_SQL}
        where value is not null and not isinf(value)""",
    "drop_missing_target": f"""select event_type, count(*) as n from {GAPPY_SQL}
        where value is not null group by event_type""",
    "feature_and_target": f"""select event_type, count(*) as n, round(max(value), 4) as largest from {GAPPY_SQL}
        where value is not null and not isinf(value) group by event_type""",
    "constant_columns": " union all ".join(
        f"""select '{c}' as "column", count("{c}") as n_values,
            count(distinct "{c}") > 1 as has_two_values from {ORDERS_PLUS_SQL} o"""
        for c in _PLUS_COLUMNS
    ),
    "datetime_columns": " union all ".join(
        f"""select '{c}' as "column", count("{c}") as n_values, {_parsed(c)}::bigint as n_parsed,
            count("{c}") = {_parsed(c)} as is_datetime from {ORDERS_PLUS_SQL} o"""
        for c in _PLUS_COLUMNS
    ),
    "remaining_columns": " union all ".join(
        f"""select '{c}' as "column", count("{c}") as n_values, count(*) - count("{c}") as n_null,
            count(distinct "{c}") as n_distinct from {ORDERS_PLUS_SQL} o"""
        for c in _PLUS_COLUMNS[:3]
    ),
    "label_encode": """select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as priority_code,
        dense_rank() over (order by o_custkey) - 1 as customer_code from orders""",
    "one_hot": """select o_orderkey, (o_orderstatus = 'F')::int::double as "o_orderstatus_F",
        (o_orderstatus = 'O')::int::double as "o_orderstatus_O",
        (o_orderstatus = 'P')::int::double as "o_orderstatus_P" from orders""",
    "one_hot_places": "select o_orderkey, dense_rank() over (order by o_custkey) - 1 as place from orders",
    "standardize": f"""with s as (select avg(o_totalprice) m, stddev_pop(o_totalprice) sd from orders
          where not ({_SPLIT} < 0.2))
        select o_orderkey, {sql_rounded('((o_totalprice - m) / sd)', 6)} as o_totalprice
        from orders, s where {_SPLIT} < 0.2""",
    "hash_split_counts": f"""select case when {_SPLIT} < 0.2 then 'test' else 'train' end as part, o_orderstatus,
        count(*) as n, sum(o_orderkey)::bigint as key_sum from orders group by 1, 2""",
    "class_counts": "select quality, count(*) as n from labels group by quality",
    "distinct_counts": " union all ".join(
        f"""select '{c}' as "column", count({c}) as n_values, count(*) - count({c}) as n_null,
            count(distinct {c}) as n_distinct from lineitem"""
        for c in DISTINCT_COLUMNS
    ),
    "distinct_values": "select distinct l_returnflag, l_linestatus from lineitem",
}
