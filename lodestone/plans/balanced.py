"""Hybrid search that gives each document in scope its own lists: statistics, ranks and quotas are kept per question and document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fuse, search
from ..sources.scratch import saved

#: Rows of a document that go on at least and at most, and how deep its lists are at least.
KEPT, DEPTH = (2, 4), 12


def _place(lists: DataFrame, kind: str, nth: int) -> DataFrame:
    """Lists of one kind (qid, query_no, doc_id, chunk_id, rank, score and the parts) with their number and weight."""
    return lists.withColumns({"list_no": F.col("query_no") * 3 + nth, "weight": fuse.list_weight(F.lit(kind), F.col("query_no"))})


def document_lists(asked: DataFrame, chunks: DataFrame, scope: DataFrame, depth: int, rules: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, chunk_id, list_no, weight, rank, score, noisy, the parts): of each query and document in scope the `depth` best
    chunks by BM25 within the document and by hash vectors, and the finds of rules.

    asked: qid, query_no, query; chunks: doc_id, chunk_id, text; scope: qid, doc_id; rules: qid, query_no, doc_id, chunk_id, rank, score.
    """
    null = F.lit(None).cast("double")
    keyed = saved(asked.select(F.concat_ws("#", "qid", "query_no").alias("qkey"), "qid", "query_no", "query"), "queries")
    wanted = search.small(keyed.join(scope, "qid").select(F.col("qkey").alias("qid"), "doc_id"))
    terms = search.query_terms(keyed.select(F.col("qkey").alias("qid"), F.col("query").alias("question")))
    sparse = search.bm25_top(chunks, terms, ["doc_id", "chunk_id"], depth, "doc_id").join(wanted, ["qid", "doc_id"], "left_semi")
    sparse = sparse.where("raw > 0").withColumn("score", F.round(search.normalised(F.col("raw")), 6))
    vectors = search.hash_lists(keyed.select(F.col("qkey").alias("qid"), F.col("query").alias("text")), "qid")
    dense = search.sparse_top_k(vectors, chunks.select("chunk_id", "doc_id", "text"), "qid", "chunk_id", depth, within="doc_id")
    dense = dense.join(wanted, ["qid", "doc_id"], "left_semi")
    names = search.small(keyed.select(F.col("qkey"), F.col("qid").alias("own_qid"), "query_no"))

    def listed(rows: DataFrame, vector: bool) -> DataFrame:
        rows = rows.withColumnRenamed("qid", "qkey").join(names, "qkey").withColumnRenamed("own_qid", "qid")
        parts = [F.col("score") if vector else null, null if vector else F.col("score"), null]
        return rows.select("qid", "query_no", "doc_id", "chunk_id", "rank", "score", *[c.alias(p) for c, p in zip(parts, fuse.PARTS, strict=True)])

    every = _place(listed(dense, True), "dense", 1).unionByName(_place(listed(sparse, False), "sparse", 2))
    if rules is not None:
        parts = [null.alias("vector_score"), null.alias("sparse_score"), F.col("score").alias("rule_score")]
        found = rules.join(scope, ["qid", "doc_id"], "left_semi").where(F.col("rank") <= depth).select("qid", "query_no", "doc_id", "chunk_id", "rank", "score", *parts)
        every = every.unionByName(_place(found, "rule", 0))
    return every.withColumn("noisy", F.lit(False)).drop("query_no")


def balanced_hybrid(asked: DataFrame, chunks: DataFrame, scope: DataFrame, k: int, rules: DataFrame | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, doc_id, chunk_id, rank, the parts, rrf_score, score): evidence balanced over the documents in scope.

    Every document's lists are fused by themselves and its two to four best rows make one more list, of weight 1.35, that is
    fused with all others; then, maybe, candidates are expanded (a function of rows with qid, doc_id, chunk_id, score, rank), and each
    document gets its best row before any gets more. Arguments are as for document_lists; every chunk_id is in one document. A
    document without a match has no rows; questions without scope aren't answered.
    """
    keep = max(KEPT[0], min(KEPT[1], k))
    scope = saved(scope.select("qid", "doc_id").distinct(), "scope")
    lists = saved(document_lists(asked, chunks, scope, max(4 * k, DEPTH), rules), "lists")
    own = fuse.rrf(lists.withColumn("qid", F.struct("qid", "doc_id")), max(4 * keep, 8), keys=("chunk_id",)).select("qid.qid", "qid.doc_id", "chunk_id", "rank", *fuse.PARTS, "score")
    best = search.top(own.withColumnRenamed("rank", "place"), keep, ["qid", "doc_id"], F.round("score", 9), "place")
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id", "rank"))).drop("place")
    first = first.withColumns({"list_no": F.lit(0), "weight": F.lit(fuse.WEIGHTS["document"]), "noisy": F.lit(False)})
    docs = scope.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")))
    per_document = 3 * (asked.agg(F.max("query_no")).head()[0] or 0) + 3
    rest = lists.join(search.small(docs), ["qid", "doc_id"]).withColumn("list_no", F.col("list_no") + 1 + (F.col("nth") - 1) * per_document).drop("nth")
    fused = fuse.rrf(rest.unionByName(first.select(rest.columns)), 2**31 - 1, keys=("doc_id", "chunk_id"))
    docs = search.small(scope.groupBy("qid").agg(F.count("*").alias("n_docs")))
    fused = fused.join(docs, "qid").where(F.col("rank") <= F.greatest(F.lit(8 * k), F.col("n_docs") * keep)).drop("n_docs")
    fused = expand(fused) if expand else fused
    fused = fused.withColumn("score", F.round("score", 9))  # equal sums in another order are still equal
    return fuse.balanced(fused.withColumnRenamed("rank", "pos"), F.greatest(F.lit(4 * k), F.col("docs") * 2), scope).drop("pos")
