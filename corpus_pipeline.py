"""The corpus pipeline: documents through five operators, each stage written as Parquet and reread by the next.

quality rules drop documents; line dedup drops repeated lines; near-duplicate
search keeps one document of each group; secret scans redact; packing cuts the
rest into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm._common import cut
from tempograph.llm.line_dedup import drop_repeated_lines
from tempograph.llm.near_dup import near_duplicates
from tempograph.llm.packing import pack_documents
from tempograph.llm.quality_rules import quality_rules
from tempograph.llm.queries import table, vocabulary
from tempograph.llm.secrets import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).where("kept").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8)."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a marker; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer and no n-gram model; a brute-force version in tests/llm stands in for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
