"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Stage 1 drops rows that the quality classifier rejects, stage 2 those that the
quality rules reject, stage 3 keeps one row of each near-duplicate group, stage 4
puts marks in the place of personal data, stage 5 packs what is left into bins.

All stages but the last return the columns that they were given, whatever their
names and order; only ``doc_id``, ``text``, ``source`` and, in stage 4, ``n_chars`` are
read or changed. Defined results of odd input:

- null text counts as empty: stage 1 scores it as a text without words, stage 2
  rejects it for its length; stages 3 and 4 leave it as it is, stage 5 gives it no bin;
- rows with a null ``doc_id`` are judged like others, never dropped as duplicates and
  packed; null ``source`` conflicts with nothing in stage 5, null labels don't count;
- rows that repeat an id and a text: stages 1 and 2 judge them alike, stage 3 keeps
  one. Of equal texts the least id stays. An id with different texts keeps each text
  that isn't linked with a smaller id;
- texts of any length are read whole; an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import classifier, minhash, packing, pii, quality_rules
from triplewright.storage import Scratch


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, labels(spark, sf_dir))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, labels(spark, sf_dir).where("quality = 1").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", best_fit),
]

#: The classifier and the minima can't be put in SQL; tests hold each stage, and all of them in turn, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
