"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

MOST_BYTES = 80 * 1024 * 1024
CASE = "id string, question string, expected_document string, expected_documents array<string>, expected_keywords array<string>, expected_evidence_keywords array<string>, gold_evidence array<struct<document: string, page: int, text_contains: array<string>>>, expected_answer_points array<string>, case_type string, difficulty string, tags array<string>, required_document_count int, expected_refusal boolean"


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx}") -> DataFrame:
    """(path, file_hash, length, content) of files that are neither empty nor over 80 MB, known by their SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES)).select("path", F.sha2("content", 256).alias("file_hash"), "length", "content")


def write_chunks(chunks: DataFrame, path: str, model: str) -> None:
    """Append chunks under their embedding model; a model is a vector space, and so a partition."""
    chunks.withColumn("embedding_model", F.lit(model)).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_no").write.mode("append").partitionBy("embedding_model").parquet(path)


def document_chunks(spark: SparkSession, path: str, scope: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks of the documents in scope (doc_id), in order; `limit` chunks a document if given."""
    rows = spark.read.parquet(path).join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.where(F.col("chunk_no") < limit) if limit else rows


def eval_suite(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a suite: a JSON file whose top level has `cases`, or is a list of cases."""
    case = StructType.fromDDL(CASE)
    rows = spark.read.schema(StructType([*case.fields, StructField("cases", ArrayType(case))])).option("multiLine", "true").json(path)
    every = rows.where("cases is not null").select(F.inline("cases")).unionByName(rows.where("cases is null").drop("cases"))
    return every.where("id is not null or question is not null")


def append_log(rows: DataFrame, path: str, kind: str) -> None:
    """Append records to a JSON-lines log, by kind and day."""
    rows.withColumn("kind", F.lit(kind)).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("kind", "day").json(path)
