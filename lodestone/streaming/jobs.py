"""Incremental forms of ingest, memory and run-log metrics; each calls the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, state


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk new documents (doc_id, pages, file_hash) into the Parquet table at `target`; content that is there is skipped, so
    a batch that runs twice changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], "file_hash string")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(target).select("file_hash").distinct()
        new = state.ingest_new(batch, known)
        chunks = chunking.chunk(new.select("doc_id", "pages"))
        chunks.join(new.select(F.col("doc_id").cast("string").alias("doc_id"), "file_hash"), "doc_id").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory(stream: DataFrame) -> DataFrame:
    """The memory table of a log as a streaming aggregate; write it in update mode."""
    return state.upsert_memory(stream)


def run_metrics(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and the sum of their values by hour and type; batch and stream alike."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
