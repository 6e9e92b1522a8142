"""Sensitivity of scores to errors, over result rows that the line items give.

Order lines stand in for scored models: the return flag is the dataset, the line number the error level
(the first line is the error-free one), and averages of the lines are the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.plans import epc
from dqimpact.queries import Query, table


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(datasetName, errorType, percentage, feature, modelName, Accuracy, Auc, Recall, Precision, F1)."""
    lines = table(spark, folder, "lineitem")
    clean = F.col("l_linenumber") == 1
    error = F.when(clean, "NULL").when(F.col("l_linestatus") == "F", "Noisy").otherwise("Outlier")
    part = F.col("l_partkey") % 3
    feature = F.when(clean, "NULL").when(part == 0, "quantity").when(part == 1, "discount").otherwise("tax")
    model = F.when(F.col("l_suppkey") % 2 == 0, "GaussianNB").otherwise("SVC")
    level = (F.col("l_linenumber") - 1).cast("double") / 10
    grouped = lines.groupBy(
        F.col("l_returnflag").alias("datasetName"),
        error.alias("errorType"),
        level.alias("percentage"),
        feature.alias("feature"),
        model.alias("modelName"),
    ).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    auc = F.when(F.col("datasetName") != "R", F.round(F.col("t") * 10, 4))
    return grouped.select(
        "datasetName",
        "errorType",
        "percentage",
        "feature",
        "modelName",
        F.round(1 - F.col("percentage") * F.col("d") * 8, 4).alias("Accuracy"),
        auc.alias("Auc"),
        F.round(F.col("q") / 50, 4).alias("Recall"),
        F.round(F.col("d") * 8, 4).alias("Precision"),
        F.round(1 - F.col("percentage") * F.col("t") * 10, 4).alias("F1"),
    )


RESULTS_SQL = """(select l_returnflag as "datasetName",
    case when l_linenumber = 1 then 'NULL' when l_linestatus = 'F' then 'Noisy' else 'Outlier' end as "errorType",
    (l_linenumber - 1)::double / 10 as percentage,
    case when l_linenumber = 1 then 'NULL' else ['quantity', 'discount', 'tax'][(l_partkey % 3 + 1)::int] end as feature,
    case when l_suppkey % 2 = 0 then 'GaussianNB' else 'SVC' end as "modelName",
    round(1 - (any_value(l_linenumber) - 1)::double / 10 * avg(l_discount) * 8, 4) as "Accuracy",
    case when l_returnflag <> 'R' then round(avg(l_tax) * 10, 4) end as "Auc",
    round(avg(l_quantity) / 50, 4) as "Recall", round(avg(l_discount) * 8, 4) as "Precision",
    round(1 - (any_value(l_linenumber) - 1)::double / 10 * avg(l_tax) * 10, 4) as "F1"
  from lineitem group by 1, 2, 3, 4, 5)"""

SERIES_SQL = '"datasetName", "errorType", feature, "modelName"'

_KEYS = f"""keys as (select m."datasetName", e."errorType", m.feature, m."modelName"
    from (select distinct "datasetName", feature, "modelName" from res where feature <> 'NULL') m
    join (select distinct "datasetName", feature, "errorType" from res where feature <> 'NULL') e
      using ("datasetName", feature))"""
_POINTS = """points as (select k."datasetName", k."errorType", k.feature, k."modelName", r.percentage, 0 as later,
      r."Accuracy", r."Auc", r."Recall", r."Precision", r."F1"
    from keys k join (select * from res where "errorType" = 'NULL') r using ("datasetName", "modelName")
    union all select "datasetName", "errorType", feature, "modelName", percentage, 1,
      "Accuracy", "Auc", "Recall", "Precision", "F1" from res where "errorType" <> 'NULL')"""


def _with(results_sql: str) -> str:
    return f"with res as (select * from {results_sql}), {_KEYS}, {_POINTS}"


_WITH = _with(RESULTS_SQL)


def _reported(value: str, spread: str) -> str:
    return (
        f"case when {spread} > 0.001 and {value} is not null and not isnan({value}) and round({value}, 4) <> 0 "
        f"then round({value}, 4) else 0.0 end"
    )


def epc_at_sql(metric: str = "Accuracy", results_sql: str = RESULTS_SQL) -> str:
    return f"""{_with(results_sql)},
      run as (select {SERIES_SQL}, percentage, -corr(percentage, "{metric}") over w as v, count(*) over w as n,
          var_samp("{metric}") over (partition by {SERIES_SQL}) as spread
        from points where "{metric}" is not null
        window w as (partition by {SERIES_SQL} order by percentage, later, "{metric}"
          rows between unbounded preceding and current row))
      select {SERIES_SQL}, percentage, {_reported('v', 'spread')} as epc_at from run where n > 1"""


def epc_sql(metrics: dict[str, str], results_sql: str = RESULTS_SQL) -> str:
    """`metrics`: score -> select list in front of the series."""
    parts = [
        f"""select {head} {SERIES_SQL}, coalesce(v, 0.0) as epc from keys left join (
          select {SERIES_SQL}, {_reported(f'-corr(percentage, "{m}")', f'var_samp("{m}")')} as v from points
          where "{m}" is not null group by {SERIES_SQL}) using ({SERIES_SQL})"""
        for m, head in metrics.items()
    ]
    return f"{_with(results_sql)} " + " union all ".join(parts)


def _over_results(plan) -> Query:
    return lambda spark, folder: plan(results(spark, folder))


QUERIES: dict[str, Query] = {
    "experiment_results": results,
    "epc_at": _over_results(epc.epc_at),
    "epc_at_f1": _over_results(lambda r: epc.epc_at(r, "F1")),
    "epc": _over_results(epc.epc),
    "epc_all_metrics": _over_results(epc.epc_all_metrics),
    "epc_sensitive": _over_results(lambda r: epc.sensitive(epc.epc_at(r))),
    "performance_trend": _over_results(epc.performance_trend),
    "epc_trend": _over_results(lambda r: epc.epc_trend(epc.epc_at(r), epc.sensitive(epc.epc_at(r)))),
}

_AT = epc_at_sql()
_SENSITIVE = "epc_at >= 0.7 and epc_at <> 1.0"

ORACLE: dict[str, str] = {
    "experiment_results": f"select * from {RESULTS_SQL}",
    "epc_at": _AT,
    "epc_at_f1": epc_at_sql("F1"),
    "epc": epc_sql({"Accuracy": ""}),
    "epc_all_metrics": epc_sql({m: f"'{m}' as metric," for m in epc.METRICS}),
    "epc_sensitive": f"select * from ({_AT}) where {_SENSITIVE}",
    "performance_trend": f"""{_WITH} select {SERIES_SQL}, percentage, "Accuracy", "Auc", "Recall", "Precision", "F1"
      from points""",
    "epc_trend": f"""with p as ({_AT}) select * from p
      where ({SERIES_SQL}) in (select ({SERIES_SQL}) from p where {_SENSITIVE})""",
}
