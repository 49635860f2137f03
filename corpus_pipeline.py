"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes the rows that the stage before it kept and returns the columns of ``documents``, but for the last,
which returns the tokens. Null texts fail the quality rules; repeated rows stay repeated until near-dedup, where one
key is one document; columns beside those of ``documents`` go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import linedup, mixing, neardup, pieces, quality
from docgraph.llm.common import drop_table, read, shared_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(docs.select(*COLUMNS))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs, pieces.model_path(), ["doc_id", "source"], ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The tokens are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)  # the stage after it is written: nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
