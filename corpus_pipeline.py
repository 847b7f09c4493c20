"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
Labels are read from sf_dir. Null or repeated ids, null texts and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, mixing, packing, pii, simhash, toxicity
from lodestone.llm.queries import MIX, domain_of_source

#: Score from which a document is rejected, as in op2.
TOXIC_AT = 0.3


def _with_text(row_columns: list[str], text) -> list:
    """The columns of documents from `row`, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in row_columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models score below TOXIC_AT. Rows of one id and text share a score, null ids too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_below(docs, labels, TOXIC_AT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id, once) of each group that SimHash links connect."""
    return simhash.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and words that disclose it replaced in their texts."""
    out = pii.sanitise(docs)
    return out.select(_with_text(docs.columns, F.col("clean_text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target mix reads: whole documents, and of each source's last one the first words.

    Rows that share an id (repeated rows too) are one unit of the seeded order; ties of that order go by id. A document that
    several epochs read is there once for each.
    """
    out = mixing.mix(docs, domain_of_source(), MIX)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("take").cast("int")), " ")
    return out.select(_with_text(docs.columns, F.when(F.col("take") < F.col("tokens"), first).otherwise(F.col("row.text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each. Pieces of one length are interchangeable; their order is by hash part, id, piece and CRC.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", sanitise), ("mixing", mix_sources), ("packing", pack)]

#: XXH64 fingerprints, the language models and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
