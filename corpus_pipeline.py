"""Corpus pipeline: from raw documents to a mixed training order, in five stages.

Each stage takes what its predecessor kept and calls one operator of the library. All but the
last return the columns of documents; the last one says how often and in which order each
document is used. Stages are written and read back by the caller, or by ``run``.

Null and empty texts are judged as empty ones, are copies of nothing, and stand once in the order;
rows with a null id stay where an id would decide; rows that share an id are judged each by its own
text, and of rows that are alike in id and words one stays. An empty table gives an empty order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaudit.llm.decontamination import drop_contaminated
from metaudit.llm.jaccard_join import one_of_each
from metaudit.llm.quality_classifier import keep_good
from metaudit.llm.shared import saved
from metaudit.llm.source_mixing import mix_sources
from metaudit.llm.substring_dedup import drop_repeated_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on their labels, rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar ones."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand earlier; n_chars follows the text. Documents stay, even if little is left."""
    found = drop_repeated_passages(docs)
    return found.select("doc_id", "text", *[F.col(f"others.{c}").alias(c) for c in docs.columns
                                            if c not in ("doc_id", "text", "n_chars")],
                        F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is found."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order and repeats of the documents, small sources raised but used four times at most."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontaminate", decontaminate), ("mix", mix)]

# A discriminant, similarity groups and hashed permutations have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
