"""From questions to judged evidence over a chunk table: search, fusion, selection, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fuse, judge, questions, search
from ..sources.scratch import saved


def retrieve(asked: DataFrame, chunks: DataFrame, k: int = 8, queries_each: int = 4) -> DataFrame:
    """(qid, citation_id, doc_id, chunk_id, rank, score parts, relevance, verdict) for questions (qid, question).

    chunks: doc_id, chunk_id, chunk_no, text. Every query of a question gives a sparse and a hash-vector list of 8k; lists are
    fused on keys, texts are joined to what fusion keeps.
    """
    chunks = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", "text")
    listed = saved(questions.expand(asked).where(F.col("query_no") < queries_each).select(F.concat_ws("#", "qid", "query_no").alias("qkey"), "qid", "query_no", "query"), "queries")
    as_question = listed.select(F.col("qkey").alias("qid"), F.col("query").alias("question"))
    sparse = search.bm25_top(chunks, search.query_terms(as_question), ["doc_id", "chunk_id"], 8 * k).withColumn("score", search.normalised(F.col("raw")))
    vectors = search.hash_lists(as_question.select("qid", F.col("question").alias("text")), "qid")
    dense = search.sparse_top_k(vectors, chunks.select("chunk_id", "text"), "qid", "chunk_id", 8 * k).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    null = F.lit(None).cast("double")
    both = dense.select("qid", F.lit("dense").alias("list"), "rank", "doc_id", "chunk_id", "score", F.col("score").alias("vector_score"), null.alias("sparse_score"))
    both = both.unionByName(sparse.select("qid", F.lit("sparse").alias("list"), "rank", "doc_id", "chunk_id", "score", null.alias("vector_score"), F.col("score").alias("sparse_score")))
    both = both.withColumnRenamed("qid", "qkey").join(search.small(listed.select("qkey", "qid", "query_no")), "qkey")
    lists = both.select("qid", (F.col("query_no") * 2 + F.when(F.col("list") == "sparse", 1).otherwise(0)).alias("list_no"), fuse.list_weight(F.col("list"), F.col("query_no")).alias("weight"), "rank", "doc_id", "chunk_id", "score", F.lit(False).alias("noisy"), "vector_score", "sparse_score", null.alias("rule_score"))
    fused = saved(fuse.rrf(lists, 8 * k), "fused")
    picked = fuse.adaptive(fused.withColumn("pos", F.col("rank")).drop("rank"), k)
    rows = picked.join(chunks.select("chunk_id", "text"), "chunk_id").join(search.small(asked.select("qid", "question", T.question_keywords(F.col("question")).alias("keywords"), T.question_phrases(F.col("question")).alias("phrases"))), "qid")
    rows = rows.withColumn("relevance", T.relevance(F.col("question"), F.col("keywords"), F.col("phrases"), T.lowered(F.col("text"))))
    rows = rows.withColumn("v", judge.verdict(F.col("score"), F.col("relevance"), T.is_table(F.col("text")), F.lit(False)))
    out = rows.select("qid", "doc_id", "chunk_id", "rank", *fuse.PARTS, "rrf_score", "score", "relevance", "v.verdict", "v.confidence", F.col("rank").alias("pos"))
    return judge.keep_judged(out).drop("pos")
