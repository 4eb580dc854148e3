"""From raw documents to packed sequences: quality rules, line dedup, near-duplicates, repeated strings, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads
again as the documents of the next stage. All stages but the last return the columns of documents; what they decide is done:
rejected documents and near-duplicates go, repeated lines and strings are cut out of the texts. A document whose lines were all
deleted stays, with an empty text: only quality rules and near-duplicates take documents away.

Nulls, ties, repeated rows, empty tables and very long texts are as each operator defines them. Columns of other names are carried
along, also where an operator uses the name for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm import lines, near, packing, quality, suffix
from sievegate.llm.common import documents, materialize, remove, scratch, tuned

#: Two documents of this similarity or more are near-duplicates of the pipeline; op8 has a threshold of its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))  # rows of one doc_id are judged each by its text and lang
    judged = quality.judge(docs.withColumns({"_text_key": key, "_lang": F.col("lang")}), spark.read.parquet(f"{sf_dir}/labels.parquet"), more=("_text_key", "_lang"))
    kept = judged.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("_text_key").alias("_kept_text"), F.col("_lang").alias("_kept_lang")).distinct()
    same = (key == F.col("_kept_text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & F.col("lang").eqNullSafe(F.col("_kept_lang"))
    return docs.join(kept, same, "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of one doc_id are one document here: they stay or go together."""
    kept = near.near_duplicates(docs, NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the tokenizer of the last stage; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage wrote for itself goes with it
            docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(path)
        remove(spark, *before)
        before = [path]
    return docs
