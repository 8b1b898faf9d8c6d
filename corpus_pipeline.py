"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, from Parquet in the shared folder,
and its decisions take effect: documents that the rules or the classifier reject
go, one document of each near-duplicate group stays, documents that overlap the
benchmark go, and the rest is packed into sequences of token ids.

Defined results: a null, empty or blank text has no words, so the quality rules
remove it. Rows that repeat an id are judged one by one, each by its own text;
of rows that repeat id and text one stays. A document without an id is treated
like the others. Extra columns of any name are carried through all stages but the
last. Empty documents, labels or benchmark tables are no error: without labels
the classifier keeps all, without benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratacell.llm import decontam, near_dedup, packing, quality_model, quality_rules
from stratacell.llm.common import new_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
