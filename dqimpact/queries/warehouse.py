"""The MODPERF fact and its dimensions, over result rows and roles that the test tables give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.plans import epc, warehouse
from dqimpact.queries import Query, table
from dqimpact.queries.sensitivity import RESULTS_SQL, epc_at_sql, results
from dqimpact.sources.config import ROLE_FIELDS, features_dim

# Feature -> field of a config that lists it.
ROLES = {"quantity": "discreteFeatures", "discount": "continousFeatures", "tax": "continousFeatures"}


def _listed(role: str) -> Column:
    names = [feature for feature, listed in ROLES.items() if listed == role]
    return F.array_intersect("seen", F.array(*map(F.lit, names)).cast("array<string>"))


def configs(spark: SparkSession, folder: str) -> DataFrame:
    """A config for each return flag: it lists the features that its lines have."""
    lines = table(spark, folder, "lineitem")
    part = F.col("l_partkey") % 3
    feature = F.when(part == 0, "quantity").when(part == 1, "discount").otherwise("tax")
    per = lines.groupBy(F.col("l_returnflag").alias("datasetName")).agg(F.collect_set(feature).alias("seen"))
    lists = {name: _listed(name) for name in ROLE_FIELDS.values()}
    return per.select("datasetName", F.lit("l_linestatus").alias("targetVariable"), *[v.alias(k) for k, v in lists.items()])


def dimension(spark: SparkSession, folder: str) -> DataFrame:
    return features_dim(configs(spark, folder))


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.load_fact(results(spark, folder))


def with_epc(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder)
    return warehouse.attach_epc(warehouse.load_fact(rows), epc.epc_at(rows))


def with_models(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.attach_models(loaded(spark, folder))


def with_feature_types(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.attach_feature_types(loaded(spark, folder), dimension(spark, folder))


def whole(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder)
    return warehouse.modperf(rows, epc.epc_at(rows), dimension(spark, folder))


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    typed = warehouse.attach_feature_types(warehouse.attach_models(loaded(spark, folder)), dimension(spark, folder))
    return warehouse.baseline_rows(typed)


QUERIES: dict[str, Query] = {
    "features_dim": dimension,
    "modperf_load": loaded,
    "modperf_epc": with_epc,
    "modperf_models": with_models,
    "modperf_feature_type": with_feature_types,
    "modperf_baseline_fanout": baselines,
    "modperf": whole,
}



def _fact(results_sql: str) -> str:
    return f"""(select "Accuracy" as "ACC", "Precision" as "PREC", "Recall" as "REC", "F1", coalesce("Auc", 0.0) as "AUC",
  "datasetName" as "DATASETNAME", "errorType" as "ERRTYPE", percentage as "ERRPERC", feature as "FEATNAME",
  "modelName" as "MODELNAME" from {results_sql})"""


_DIM = """(select distinct l_returnflag as "datasetName", ['quantity', 'discount', 'tax'][(l_partkey % 3 + 1)::int] as feature,
    case when l_partkey % 3 = 0 then 'discrete' else 'continue' end as type from lineitem
  union all select distinct l_returnflag, 'l_linestatus', 'target' from lineitem)"""
_MODELS = "(values " + ", ".join(f"('{local}', '{shown}', '{kind}')" for _, local, shown, kind in warehouse.MODELS) + ")"
_COLUMNS = ", ".join(f'"{c}"' for c in warehouse.MODPERF)


def _named(fact: str) -> str:
    return f"""(select f.* exclude ("MODELNAME"), coalesce(m.shown, f."MODELNAME") as "MODELNAME", m.kind as "MODELTYPE"
  from {fact} f left join {_MODELS} m(local, shown, kind) on f."MODELNAME" = m.local)"""


def _typed(named: str, dim: str) -> str:
    return f"""(select n.*, d.type as "FEATTYPE" from {named} n
  left join {dim} d on n."DATASETNAME" = d."datasetName" and n."FEATNAME" = d.feature)"""


def _base(typed: str) -> str:
    return f"""(select s."ACC", s."PREC", s."REC", null::double as "EPC", s."F1", s."AUC", s."DATASETNAME", k."ERRTYPE",
    0.0::double as "ERRPERC", k."FEATTYPE", k."FEATNAME", s."MODELNAME", k."MODELTYPE"
  from (select distinct "DATASETNAME", "MODELNAME", "ACC", "PREC", "REC", "F1", "AUC" from {typed} t where "ERRPERC" = 0.0) s
  join (select distinct "DATASETNAME", "MODELNAME", "FEATNAME", "FEATTYPE", "ERRTYPE", "MODELTYPE" from {typed} t) k
    using ("DATASETNAME", "MODELNAME"))"""


def _with_epc(results_sql: str) -> str:
    at = f"""(select "datasetName", "errorType", feature, "modelName", percentage, max(epc_at) as "EPC"
  from ({epc_at_sql(results_sql=results_sql)}) group by 1, 2, 3, 4, 5)"""
    return f"""(select f.*, a."EPC" from {_fact(results_sql)} f left join {at} a on f."DATASETNAME" = a."datasetName"
  and f."ERRTYPE" = a."errorType" and f."FEATNAME" = a.feature and f."MODELNAME" = a."modelName" and f."ERRPERC" = a.percentage)"""


def modperf_sql(results_sql: str, dim: str) -> str:
    """The whole fact from a table of result rows and one of feature roles."""
    typed = _typed(_named(_with_epc(results_sql)), dim)
    base = _base(_typed(_named(_fact(results_sql)), dim))
    return f"select {_COLUMNS} from {typed} union all select {_COLUMNS} from {base}"


_FACT = _fact(RESULTS_SQL)
_NAMED = _named(_FACT)

ORACLE: dict[str, str] = {
    "features_dim": f"select * from {_DIM}",
    "modperf_load": f"select * from {_FACT}",
    "modperf_epc": f"""select "DATASETNAME", "ERRTYPE", "MODELNAME", "FEATNAME", "ERRPERC", "ACC", "PREC", "REC", "F1",
      "AUC", "EPC" from {_with_epc(RESULTS_SQL)}""",
    "modperf_models": f"""select "ACC", "PREC", "REC", "F1", "AUC", "DATASETNAME", "ERRTYPE", "ERRPERC", "FEATNAME",
      "MODELNAME", "MODELTYPE" from {_NAMED}""",
    "modperf_feature_type": f"""select f."DATASETNAME", f."FEATNAME", f."ACC", f."PREC", f."REC", f."F1", f."AUC",
      f."ERRTYPE", f."ERRPERC", f."MODELNAME", d.type as "FEATTYPE" from {_FACT} f
      left join {_DIM} d on f."DATASETNAME" = d."datasetName" and f."FEATNAME" = d.feature""",
    "modperf_baseline_fanout": f"select {_COLUMNS} from {_base(_typed(_NAMED, _DIM))}",
    "modperf": modperf_sql(RESULTS_SQL, _DIM),
}
