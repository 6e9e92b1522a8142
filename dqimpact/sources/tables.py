"""Reading and writing datasets and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqimpact.operators.running import running_totals
from dqimpact.sources.config import base_name, table_name

# Columns and types of the result tables.
EXPERIMENTS = T.StructType(
    [
        T.StructField("datasetName", T.StringType()),
        T.StructField("errorType", T.StringType()),
        T.StructField("percentage", T.DoubleType()),
        T.StructField("feature", T.StringType()),
        T.StructField("modelName", T.StringType()),
        T.StructField("Accuracy", T.DoubleType()),
        T.StructField("Auc", T.DoubleType()),
        T.StructField("Recall", T.DoubleType()),
        T.StructField("Precision", T.DoubleType()),
        T.StructField("F1", T.DoubleType()),
    ]
)
EPC_AT = T.StructType(
    [
        T.StructField("datasetName", T.StringType()),
        T.StructField("errorType", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("modelName", T.StringType()),
        T.StructField("percentage", T.DoubleType()),
        T.StructField("epc_at", T.DoubleType()),
    ]
)

INDEX = ","
NO_ERROR = "NULL"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Read a dataset: a parquet or ORC folder or file, or CSV with a header.

    Give a schema for large CSV input, since inferring types costs a second pass over it.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_columns(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names only; CSV types are not inferred, so nothing but the header is read."""
    if path.rstrip("/").lower().endswith((".parquet", ".orc")):
        return read_table(spark, path).columns
    return spark.read.option("header", True).option("encoding", encoding).csv(path).columns


def preview(spark: SparkSession, path: str, rows: int = 15, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path).limit(rows)


def align(test: DataFrame, train: DataFrame) -> DataFrame:
    """Bring a separate test set to the columns and types of the training set."""
    return test.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in train.schema.fields])


def with_index_field(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(INDEX, T.IntegerType()), *schema.fields])


def source_name(path: Column) -> Column:
    """Name of the file that a row came from; of its folder, if the file is a part of a written table."""
    whole = F.regexp_replace(path, r"/part-[^/]*$", "")
    return base_name(whole)


def read_experiments(spark: SparkSession, path: str | Sequence[str], indexed: bool = True) -> DataFrame:
    """Result CSVs of one folder or of many files as one table, with the file each row came from.

    A file may be a folder of parts.  Correlation outputs that lie in the same folder are left out by name,
    a condition on the metadata of files alone, so they are not opened; their columns are others.
    """
    schema = with_index_field(EXPERIMENTS) if indexed else EXPERIMENTS
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    named = raw.withColumn("file", source_name(F.col("_metadata.file_path")))
    return named.filter(F.col("file") != "correlation_results.csv").drop(INDEX)


def read_epc(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """EPC result CSVs of one folder or of many files as one table."""
    return spark.read.schema(EPC_AT).option("header", True).csv(path)


def loaded_files(df: DataFrame) -> DataFrame:
    """Names of the files behind a multi-file read, as the warehouse lists them."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return df.select(table_name(stem).alias("name")).distinct()


def with_row_index(df: DataFrame, order: Sequence[str], index: str = INDEX) -> DataFrame:
    """Put a 0..n-1 column in front, counted in the given order without a one-task sort."""
    numbered = running_totals(df, [], order, {"_row": F.lit(1).cast("bigint")})
    return numbered.select(F.col("_row").alias(index), *[F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write CSV with a header; with `order` the part files follow each other in that order."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a CSV folder, or create it."""
    write_csv(df, path, mode="append")


def export_experiments(results: DataFrame, path: str) -> None:
    keys = ["datasetName", "errorType", "feature", "percentage", "modelName"]
    write_csv(with_row_index(results.select(*EXPERIMENTS.names), keys), path, order=[f"`{INDEX}`"])


def save_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store scored rows as parquet, one folder per dataset, so later reads prune by dataset.

    Only the datasets among the rows are replaced, so a rerun leaves the results of others alone.
    """
    kept = results.select(*EXPERIMENTS.names).repartition("datasetName")
    kept.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("datasetName").parquet(path)


def save_and_load(results: DataFrame, path: str) -> DataFrame:
    """Rows that several jobs start from, stored so that they are made once."""
    save_results(results, path)
    return load_results(results.sparkSession, path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENTS).parquet(path).select(*EXPERIMENTS.names)


def export_epc(at: DataFrame, whole: DataFrame, sensitive: DataFrame, path: str) -> None:
    """The three EPC files: all points by percentage, one value per series, the sensitive points."""
    series = ["datasetName", "errorType", "feature", "modelName"]
    write_csv(at, f"{path}/epc_at", order=["percentage", *series])
    write_csv(whole, f"{path}/epc", order=series)
    write_csv(sensitive, f"{path}/epc_at_sorted", order=["epc_at", *series, "percentage"])
