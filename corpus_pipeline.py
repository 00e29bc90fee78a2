"""Documents made ready for training: quality rules, line dedup, near-duplicates, secrets, packing.

Each stage works on all that the one before it kept. All but the last return the columns of documents;
``n_chars`` follows the text. Stages hand over their rows as Parquet below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from catalens.llm.columns import NOT_SPACE, fresh
from catalens.llm.query_tokens import tokenizer_file
from catalens.sources.shared import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    judged, kept = quality_rules.apply_rules(docs), _added(docs, "kept")
    return judged.filter(F.col(kept)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose every word go."""
    deduped = line_dedup.dedup_lines(docs)
    left = (F.col(_added(docs, "n_deleted")) == 0) | F.col("text").rlike(NOT_SPACE)
    return deduped.filter(left).withColumn("n_chars", _size()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 0.8 or more."""
    return ngram_join.one_per_group(docs, n=5, threshold=Fraction(4, 5)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in the place of every secret."""
    found = secret_scan.scan_secrets(docs)
    clean = secret_scan.redact(F.col("text"), F.col(_added(docs, "all_spans")))
    return found.withColumn("text", clean).withColumn("n_chars", _size()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each."""
    return packing.pack_documents(docs, tokenizer_file())


def _added(docs: DataFrame, name: str) -> str:
    """Name that an operator gives to its column ``name`` where documents may have one like it."""
    return fresh(docs, name)[0]


def _size():
    return F.coalesce(F.length("text"), F.lit(0)).cast("long")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]

#: The tokenizer's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
