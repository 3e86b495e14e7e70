"""Corpus preparation in five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.llm import blocks
from worksight.llm.decontamination import decontaminate
from worksight.llm.jaccard_join import jaccard_components
from worksight.llm.line_dedup import line_dedup
from worksight.llm.quality_rules import quality_rules
from worksight.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them documents that fail or lose too much."""
    out = quality_rules(docs).filter("kept")
    return out.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages go, and documents of which nothing is left."""
    out = line_dedup(docs, window=3).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by five-word shingle sets with a similarity of 0.8 one stays: that of the least doc_id (null last), then of the least row key.

    Rows are told apart by a hash of all their columns, not by doc_id; of rows that are equal in all columns one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))  # nulls alone leave the hash as it is
    found = jaccard_components(rows, k=5, percent=80, id_column="row_key").select("row_key", "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = found.distinct().join(rows.select("row_key", "doc_id").distinct(), "row_key").groupBy("component_id").agg(F.min(first).alias("first"))
    return rows.join(kept.select(F.col("first.row_key").alias("row_key")), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of the documents that are left."""
    return encode(docs).select("doc_id", "lang", "source", "n_pieces", "piece_ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("sentencepiece", pieces),
]
#: The near-duplicate and the last stage have no SQL form. Tests hold the operators behind the stages against plain versions, and the whole run
#: only against what must hold of its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.materialise(stage(spark, docs, sf_dir), name)
    return blocks.materialise(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
