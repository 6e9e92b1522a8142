"""From raw documents to token files: clean, deduplicate, decontaminate, mix, encode.

Each stage gets what the one before it kept, as a stored table; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqimpact.llm.decontaminate import decontaminated
from dqimpact.llm.mixing import TELLING, copies, mixing_rates
from dqimpact.llm.ngram_join import ngram_components
from dqimpact.llm.quality_rules import quality_rules
from dqimpact.llm.store import shared_folder, stored, table
from dqimpact.llm.token_files import checksums, read_token_files, write_token_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; documents that the rules reject go."""
    kept = quality_rules(docs.select(*COLUMNS)).filter("kept")
    return kept.select(
        "doc_id",
        F.col("cleaned_text").alias("text"),
        "lang",
        "source",
        F.length("cleaned_text").cast("long").alias("n_chars"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Rows without doc_id belong to no group and stay; of rows that share a doc_id all stay or all go.
    """
    groups = ngram_components(docs)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as its rate says; the target weights are those of the documents judged clean."""
    rated = mixing_rates(docs, table(spark, sf_dir, "labels"), keep=COLUMNS, like="clean", classifier=TELLING)
    taken = rated.withColumn("_copies", copies(F.col("rate"), F.col("doc_id"))).filter("_copies > 0")
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what a reader finds in them of every document."""
    path = shared_folder(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return checksums(read_token_files(spark, path))


STAGES = [
    ("quality rules", clean),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("token files", tokenize),
]

# Projected gradients and a tokenizer cannot be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each on the stored result of the one before it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
