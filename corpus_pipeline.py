"""From raw documents to a decontaminated mix, in five stages.

Every stage takes all that its predecessor kept and returns the columns of ``documents``;
the last returns the mix.  A stage's result is a table in the shared folder, which the
next one reads.  Rows with nulls, empty texts or repeated ids are treated as the stage's
operator says; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.llm import count_tree, deobfuscate, line_templates, mixing, positional_index
from landspan.llm.store import save


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the deobfuscating model, fitted on their labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return deobfuscate.tolerable(docs, deobfuscate.fit(deobfuscate.training(docs, labels, "toxic", 2, 4)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose templates recur; ``n_chars`` follows the text."""
    out = line_templates.cleaned(docs)
    n = F.when(F.size("_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    return count_tree.first_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return positional_index.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.taken(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: SQL has no word for the trained stage; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
