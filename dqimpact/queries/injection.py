"""Error injection, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.functions.stats import rounded
from dqimpact.operators import inject
from dqimpact.queries import LEVELS_SQL, Query, sql_draw, sql_rounded, sql_share, table

STEPS = inject.levels(0.2)


def _query(name: str, key: str, column: str, role: str, error: str, digits: int | None = None, **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, name).select(key, column)
        made = inject.inject_levels(rows, column, role, error, STEPS, key, **options)
        value = F.col(column) if digits is None else rounded(F.col(column), digits)
        return made.select(key, "percentage", value.alias("value"))

    return run


def _sql(name: str, key: str, column: str, error: str, dirty: str, digits: int | None = None, stats: str = "") -> str:
    value = f"case when u < p then {dirty} else x end"
    value = value if digits is None else sql_rounded(f"({value})", digits)
    summary = f"select {stats} from (select {column} as x from {name})" if stats else "select 1 as one"
    return f"""with s as ({summary}),
      r as (select {key} as k, {column} as x, {sql_share(error, column, key)} as u,
             {sql_draw(error, column, key, 'v')} as h2 from {name})
      select k as {key}, p as percentage, {value} as value from r, s, {LEVELS_SQL}"""


BOUNDS = "min(x) as lo, max(x) as hi"
SPREAD = "avg(x) as m, stddev_samp(x) as sd"
DOMAIN = "list_sort(list(distinct x)) as d, count(distinct x) as k_values"
OTHER = "case when d[(h2 % (k_values - 1)) + 1] = x then d[k_values] else d[(h2 % (k_values - 1)) + 1] end"
REACH = "((3.0 + h2 / 4294967296.0) * sd)"


def wrong_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    parts = [
        inject.wrong_labels(labels, "quality", s.share, "doc_id").select(
            "doc_id", F.lit(s.label).alias("percentage"), "quality"
        )
        for s in STEPS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def duplicate_all(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return inject.duplicate(events, 0.4, "event_id")


def duplicate_class(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return inject.duplicate(labels, 0.6, "doc_id", target="quality", target_value=0)


def level_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rows at every level of three step widths."""
    events = table(spark, folder, "events").select("event_id", "value")
    parts = []
    for step in (0.1, 0.2, 0.25):
        made = inject.inject_levels(events, "value", "continous", "missing", inject.levels(step), "event_id")
        hits = made.groupBy("percentage").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_hit")
        )
        parts.append(hits.select(F.lit(step).alias("step"), "percentage", "n", "n_hit"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 40% of the rows lose their value."""
    events = table(spark, folder, "events").select("event_id", "value")
    rows = events.count() * 2 // 5
    cut = inject.exact_cut(events, rows, "event_id", 42, "missing", "value")
    hit = inject.exact_hit(cut, "event_id", 42, "missing", "value")
    return events.withColumn("value", F.when(~hit, F.col("value")))


def _sweep(error: str, carry_over: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder, "events").select("event_id", "user_id", "value")
        features = [("value", "continous"), ("user_id", "discrete")]
        swept = inject.sweep_levels(events, features, error, STEPS, "event_id", carry_over=carry_over)
        return swept.groupBy("feature", "percentage").agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.avg("value"), 4).alias("value_mean"),
            rounded(F.avg("user_id"), 4).alias("user_mean"),
            rounded(F.max("value"), 4).alias("value_max"),
            F.max("user_id").alias("user_max"),
        )

    return run


def _sweep_sql(error: str, carry_over: bool) -> str:
    if error == "noise":
        value = "vlo + vh / 4294967296.0 * (vhi - vlo)"
        user = "ulo + (uh % (uhi - ulo + 1))"
    else:
        reach = "((3.0 + {h} / 4294967296.0) * {s})"
        v, u = reach.format(h="vh", s="vs"), reach.format(h="uh", s="us")
        value = f"case when vh % 2 = 0 then vm + {v} else vm - {v} end"
        user = f"case when uh % 2 = 0 then ceil(um + {u})::bigint else floor(um - {u})::bigint end"
    base = f"case when vu < 0.8 then {value} else value end" if carry_over else "value"
    return f"""with s as (select min(value) vlo, max(value) vhi, avg(value) vm, stddev_samp(value) vs,
        min(user_id) ulo, max(user_id) uhi, avg(user_id) um, stddev_samp(user_id) us from events),
      r as (select event_id, value, user_id, {sql_share(error, 'value', 'event_id')} vu,
        {sql_draw(error, 'value', 'event_id', 'v')} vh, {sql_share(error, 'user_id', 'event_id')} uu,
        {sql_draw(error, 'user_id', 'event_id', 'v')} uh from events),
      w as (select 'value' as feature, p, case when vu < p then {value} else value end as v, user_id as c
            from r, s, {LEVELS_SQL}
        union all
        select 'user_id', p, {base}, case when uu < p then {user} else user_id end from r, s, {LEVELS_SQL})
      select feature, p as percentage, count(*) as n, {sql_rounded('avg(v)', 4)} as value_mean,
        {sql_rounded('avg(c)', 4)} as user_mean, {sql_rounded('max(v)', 4)} as value_max, max(c) as user_max
      from w group by feature, p"""


def noise_cat_decimal(spark: SparkSession, folder: str) -> DataFrame:
    """Categories that are decimals: they are drawn in the order of their numbers."""
    rows = table(spark, folder, "events").select("event_id", F.floor("value").cast("decimal(18,2)").alias("level"))
    made = inject.inject_levels(rows, "level", "categoricalInteger", "noise", STEPS, "event_id")
    return made.select("event_id", "percentage", F.col("level").cast("double").alias("value"))


QUERIES: dict[str, Query] = {
    "noise_discrete": _query("part", "p_partkey", "p_size", "discrete", "noise"),
    "noise_continuous": _query("events", "event_id", "value", "continous", "noise", 6),
    "noise_binary": _query("labels", "doc_id", "toxic", "binary", "noise"),
    "noise_cat_string": _query("orders", "o_orderkey", "o_orderpriority", "categoricalString", "noise"),
    "noise_cat_int": _query("customer", "c_custkey", "c_nationkey", "categoricalInteger", "noise"),
    "noise_cat_large": _query("orders", "o_orderkey", "o_custkey", "categoricalInteger", "noise"),
    "noise_cat_decimal": noise_cat_decimal,
    "missing": _query("events", "event_id", "value", "continous", "missing", 6),
    "outlier_discrete": _query("part", "p_partkey", "p_size", "discrete", "outlier"),
    "outlier_continuous": _query("events", "event_id", "value", "continous", "outlier", 4),
    "outlier_cat_string": _query("orders", "o_orderkey", "o_orderpriority", "categoricalString", "outlier"),
    "outlier_cat_int": _query("customer", "c_custkey", "c_nationkey", "categoricalInteger", "outlier"),
    "wrong_labels": wrong_labels,
    "duplicate_all": duplicate_all,
    "duplicate_class": duplicate_class,
    "level_schedule": level_schedule,
    "missing_exact": missing_exact,
    "noise_sweep": _sweep("noise", False),
    "noise_sweep_carried": _sweep("noise", True),
    "outlier_sweep": _sweep("outlier", False),
}

ORACLE: dict[str, str] = {
    "noise_discrete": _sql("part", "p_partkey", "p_size", "noise", "(lo + h2 % (hi - lo + 1))::int", None, BOUNDS),
    "noise_continuous": _sql("events", "event_id", "value", "noise", "lo + h2 / 4294967296.0 * (hi - lo)", 6, BOUNDS),
    "noise_binary": _sql("labels", "doc_id", "toxic", "noise", "case when x = lo then hi else lo end", None, BOUNDS),
    "noise_cat_string": _sql("orders", "o_orderkey", "o_orderpriority", "noise", OTHER, None, DOMAIN),
    "noise_cat_int": _sql("customer", "c_custkey", "c_nationkey", "noise", OTHER, None, DOMAIN),
    "noise_cat_large": _sql("orders", "o_orderkey", "o_custkey", "noise", OTHER, None, DOMAIN),
    "noise_cat_decimal": _sql(
        "(select event_id, floor(value) as level from events)", "event_id", "level", "noise", OTHER, None, DOMAIN
    ),
    "missing": _sql("events", "event_id", "value", "missing", "null", 6),
    "outlier_discrete": _sql(
        "part", "p_partkey", "p_size", "outlier",
        f"(case when h2 % 2 = 0 then ceil(m + {REACH}) else floor(m - {REACH}) end)::int", None, SPREAD,
    ),
    "outlier_continuous": _sql(
        "events", "event_id", "value", "outlier",
        f"case when h2 % 2 = 0 then m + {REACH} else m - {REACH} end", 4, SPREAD,
    ),
    "outlier_cat_string": _sql(
        "orders", "o_orderkey", "o_orderpriority", "outlier", f"'{inject.OUTLIER_TOKEN}'"
    ),
    "outlier_cat_int": _sql(
        "customer", "c_custkey", "c_nationkey", "outlier", "(hi + 1 + h2 % (hi - lo + 1))::int", None, BOUNDS
    ),
    "wrong_labels": f"""select doc_id, p as percentage,
        case when {sql_share('labels', 'quality', 'doc_id')} < p then 1 - quality else quality end as quality
        from labels, {LEVELS_SQL}""",
    "duplicate_all": f"""select event_id, event_type, value, 0 as is_copy from events union all
        select event_id, event_type, value, 1 from events where {sql_share('duplicate', 'row', 'event_id')} < 0.4""",
    "duplicate_class": f"""select *, 0 as is_copy from labels union all
        select *, 1 from labels where quality = 0 and {sql_share('duplicate', 'row', 'doc_id')} < 0.6""",
    "level_schedule": f"""select step, p as percentage, count(*) as n, count(*) filter (where u < p) as n_hit
        from (select {sql_share('missing', 'value', 'event_id')} as u from events),
          (select 0.1::double as step, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as p union all
           select 0.2, unnest([0.2, 0.4, 0.6, 0.8]::double[]) union all
           select 0.25, unnest([0.25, 0.5, 0.75]::double[])) lv group by step, p""",
    "missing_exact": f"""select event_id, case when row_number() over (order by h, event_id) * 5 <= 2 * count(*) over ()
        then null else value end as value
        from (select event_id, value, {sql_draw('missing', 'value', 'event_id')} as h from events)""",
    "noise_sweep": _sweep_sql("noise", False),
    "noise_sweep_carried": _sweep_sql("noise", True),
    "outlier_sweep": _sweep_sql("outlier", False),
}
