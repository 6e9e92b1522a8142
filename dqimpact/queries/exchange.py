"""Datasets, result tables and configs written to files and read back.

Every query writes to a new shared folder and returns what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.operators import clean
from dqimpact.plans import epc
from dqimpact.queries import Query, table
from dqimpact.queries.sensitivity import RESULTS_SQL, epc_at_sql, epc_sql, results
from dqimpact.queries.warehouse import ORACLE as WAREHOUSE
from dqimpact.queries.warehouse import configs
from dqimpact.session import shared_folder
from dqimpact.sources import tables
from dqimpact.sources.config import features_dim, normalise_configs, read_configs, write_configs

DATASETS = ("A", "N", "R")
RESULT_KEYS = ("datasetName", "errorType", "feature", "percentage", "modelName")


def csv_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset in CSV: header and types are found by the reader."""
    path = shared_folder(spark, "orders") + ".csv"
    given = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.write_csv(given, path)
    names = tables.read_columns(spark, path)
    read = tables.read_table(spark, path).select(*names)
    return read.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


def latin_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset in another encoding, with letters beyond ASCII: words of the documents that hold such letters."""
    path = shared_folder(spark, "words") + ".csv"
    words = table(spark, folder, "documents").select(F.explode(F.split("text", "[^a-z\u00df-\u00ff]+")).alias("word"))
    counted = words.filter(F.col("word").rlike("[\u00df-\u00ff]")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    schema = "word string, n long"
    return tables.read_table(spark, path, schema=schema, encoding="ISO-8859-1")


def aligned_test_set(spark: SparkSession, folder: str) -> DataFrame:
    """A separate test set, with its columns as text, in another order and with one more, like the training table."""
    path = shared_folder(spark, "test") + ".csv"
    orders = table(spark, folder, "orders")
    train = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.write_csv(orders.select("o_orderstatus", "o_custkey", "o_totalprice", "o_orderkey"), path)
    as_text = tables.read_table(spark, path, schema="o_orderstatus string, o_custkey string, o_totalprice string, o_orderkey string")
    return tables.align(as_text, train)


def _exported(spark: SparkSession, folder: str) -> str:
    """A folder with result files of three datasets and a file of correlations."""
    path = shared_folder(spark, "experiments")
    rows = tables.save_and_load(results(spark, folder), shared_folder(spark, "results"))
    for dataset in DATASETS:
        tables.export_experiments(rows.filter(F.col("datasetName") == dataset), f"{path}/experiments-{dataset}.csv")
    weights = rows.groupBy("feature").agg(F.covar_pop("percentage", "Accuracy").alias("Correlation"))
    tables.append_csv(weights, f"{path}/correlation_results.csv")
    return path


def folder_results(spark: SparkSession, folder: str) -> DataFrame:
    """All result files of a folder as one table; the correlations that lie beside them are left out."""
    return tables.read_experiments(spark, f"{_exported(spark, folder)}/*")


def loaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """The names of those files as the warehouse has them."""
    return tables.loaded_files(folder_results(spark, folder))


def exported_rows(spark: SparkSession, folder: str) -> DataFrame:
    """An export with the rows numbered in front, in the order of their keys."""
    path = f"{_exported(spark, folder)}/experiments-N.csv"
    read = tables.read_table(spark, path, schema=tables.with_index_field(tables.EXPERIMENTS))
    return read.withColumnRenamed(tables.INDEX, "row")


def _corrected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Accuracy", F.col("Accuracy") / 2)


def rerun_results(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table of all datasets after a rerun of one: its rows are replaced, those of others stay."""
    path, rows = shared_folder(spark, "results"), results(spark, folder)
    tables.save_results(rows, path)
    tables.save_results(_corrected(rows.filter("datasetName = 'R'")), path)
    return tables.load_results(spark, path)


def emptied_results(spark: SparkSession, folder: str) -> DataFrame:
    """A table emptied before it is loaded anew: what it held before is gone."""
    path, rows = shared_folder(spark, "fact"), results(spark, folder)
    tables.write_csv(rows, path)
    tables.write_csv(_corrected(rows.filter("datasetName <> 'R'")), path)
    return tables.read_table(spark, path, schema=tables.EXPERIMENTS)


def appended_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows appended dataset by dataset, the first of which makes the table."""
    path, rows = shared_folder(spark, "scores"), results(spark, folder)
    for dataset in DATASETS:
        tables.append_csv(rows.filter(F.col("datasetName") == dataset), path)
    return tables.read_table(spark, path, schema=tables.EXPERIMENTS)


def epc_exports(spark: SparkSession, folder: str) -> DataFrame:
    """The three EPC files, read back: all points, one value for each series, the sensitive points."""
    path = shared_folder(spark, "epc")
    rows = tables.save_and_load(results(spark, folder), shared_folder(spark, "results"))
    at = epc.epc_at(rows)
    tables.export_epc(at, epc.epc(rows), epc.sensitive(at), path)
    whole = tables.read_table(
        spark, f"{path}/epc", schema="datasetName string, errorType string, feature string, modelName string, epc double"
    )
    series = whole.select(F.lit("epc").alias("file"), *whole.columns[:4], F.lit(None).cast("double").alias("percentage"),
                          F.col("epc").alias("value"))
    for name in ("epc_at", "epc_at_sorted"):
        points = tables.read_epc(spark, f"{path}/{name}").withColumnRenamed("epc_at", "value")
        series = series.unionByName(points.withColumn("file", F.lit(name)))
    return series


def folder_configs(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of configs, one file for each dataset, read back: the roles of all features."""
    path = shared_folder(spark, "configs")
    made = configs(spark, folder).withColumns(
        {
            "testset": F.lit(None).cast("string"),
            "machineLearningModels": F.array(F.lit("Naive Bayes")),
            "Experiments": F.array(
                F.struct(
                    F.lit("noise").alias("Errortype"), F.lit(None).cast("string").alias("Errotype"),
                    F.lit("discrete").alias("FeatureType"), F.lit("0.2").alias("Step"),
                    F.lit(None).cast("array<string>").alias("FeatureArray"), F.lit(None).cast("array<string>").alias("columns"),
                    F.lit(None).cast("array<string>").alias("machineLearningModels"), F.lit(None).cast("string").alias("case"),
                    F.lit(None).cast("string").alias("target_value"),
                )
            ),
            "targetVariabile": F.lit(None).cast("string"),
        }
    )
    write_configs(normalise_configs(made), path)
    return features_dim(read_configs(spark, path))


def text_column_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Values, gaps and different values of all columns that hold text."""
    lines = table(spark, folder, "lineitem")
    return clean.column_counts(lines.select(*clean.text_columns(lines)))


QUERIES: dict[str, Query] = {
    "csv_dataset": csv_dataset,
    "latin_dataset": latin_dataset,
    "aligned_test_set": aligned_test_set,
    "folder_results": folder_results,
    "loaded_files": loaded_files,
    "exported_rows": exported_rows,
    "rerun_results": rerun_results,
    "emptied_results": emptied_results,
    "appended_rows": appended_rows,
    "epc_exports": epc_exports,
    "folder_configs": folder_configs,
    "text_column_counts": text_column_counts,
}

_KEYS = ", ".join(f'"{c}"' for c in RESULT_KEYS)
_SCORES = '"Auc", "Recall", "Precision", "F1"'
_HALVED = f'"datasetName", "errorType", percentage, feature, "modelName", "Accuracy" / 2 as "Accuracy", {_SCORES}'
_SERIES = '"datasetName", "errorType", feature, "modelName"'
_TEXTS = [
    f"""select '{c}' as "column", count({c}) as n_values, count(*) - count({c}) as n_null,
      count(distinct {c}) as n_distinct from lineitem"""
    for c in ("l_returnflag", "l_linestatus")
]

ORACLE: dict[str, str] = {
    "csv_dataset": "select o_orderkey, o_totalprice, o_orderstatus from orders",
    "latin_dataset": """select word, count(*) as n from (
        select unnest(regexp_extract_all(text, '[a-z\u00df-\u00ff]+')) as word from documents)
      where regexp_matches(word, '[\u00df-\u00ff]') group by word""",
    "aligned_test_set": "select o_orderkey, o_totalprice, o_orderstatus from orders",
    "folder_results": f"""select *, 'experiments-' || "datasetName" || '.csv' as file from {RESULTS_SQL}""",
    "loaded_files": """select distinct 'experiments_' || l_returnflag as name from lineitem""",
    "exported_rows": f"""select (row_number() over (order by {_KEYS}) - 1)::int as "row", * from {RESULTS_SQL}
      where "datasetName" = 'N'""",
    "rerun_results": f"""select * from {RESULTS_SQL} where "datasetName" <> 'R' union all
      select {_HALVED} from {RESULTS_SQL} where "datasetName" = 'R'""",
    "emptied_results": f"""select {_HALVED} from {RESULTS_SQL} where "datasetName" <> 'R'""",
    "appended_rows": f"select * from {RESULTS_SQL}",
    "epc_exports": f"""select 'epc' as file, {_SERIES}, null::double as percentage, epc as value
        from ({epc_sql({"Accuracy": ""})}) union all
      select 'epc_at', {_SERIES}, percentage, epc_at from ({epc_at_sql()}) union all
      select 'epc_at_sorted', {_SERIES}, percentage, epc_at from ({epc_at_sql()}) where epc_at >= 0.7 and epc_at <> 1.0""",
    "folder_configs": WAREHOUSE["features_dim"],
    "text_column_counts": " union all ".join(_TEXTS),
}
