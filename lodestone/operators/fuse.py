"""Fusion of ranked lists, and selection balanced over documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("vector_score", "sparse_score", "rule_score")
#: The rank constant, and weights of the lists; queries after the first weigh less.
RRF_K = 60.0
WEIGHTS = {"rule": 1.15, "dense": 1.0, "sparse": 1.0, "document": 1.35}
LATER_QUERY = 0.82


def list_weight(name: Column, query_no: Column) -> Column:
    base = F.coalesce(*[F.when(name == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(1.0))
    return base * F.when(query_no == 0, 1.0).otherwise(LATER_QUERY)


def rrf(lists: DataFrame, limit: int, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists (qid, list_no, weight, rank, keys, score, noisy, the PARTS).

    The sum of weight / (60 + rank) orders, then what was seen first. A key's own score is that of its representative: its first
    item, replaced by one with a higher score or by a clean one if it is noisy. The final score is that or the share of the
    best sum, whichever is larger. Null parts stay null if no list gives them.
    """
    item = F.struct("list_no", "rank", "score", F.coalesce("noisy", F.lit(False)).alias("noisy"))
    better = lambda now, new: F.when(now.isNull() | (new["score"] > now["score"]) | (now["noisy"] & ~new["noisy"]), new).otherwise(now)
    nothing = F.expr("CAST(NULL AS STRUCT<list_no: INT, rank: INT, score: DOUBLE, noisy: BOOLEAN>)")
    lists = lists.withColumns({"list_no": F.col("list_no").cast("int"), "rank": F.col("rank").cast("int"), "score": F.col("score").cast("double")})
    merged = lists.groupBy("qid", *keys).agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("sum"), F.min(F.struct("list_no", "rank")).alias("seen"), F.array_sort(F.collect_list(item)).alias("items"), *[F.max(p).alias(p) for p in PARTS])
    best = F.max("sum").over(Window.partitionBy("qid"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("sum", 12)), "seen")
    out = merged.withColumn("own", F.aggregate("items", nothing, better)["score"]).withColumn("rrf_score", F.least(F.lit(1.0), F.col("sum") / best)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit).select("qid", *keys, "rank", *PARTS, "rrf_score", F.greatest("own", "rrf_score").alias("score"))


def distinct_text(text: Column) -> Column:
    """The key by which texts count as the same: lower case, squeezed, 260 characters."""
    return F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))), 1, 260)


def first_of(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def balanced(rows: DataFrame, limit: int | Column, targets: DataFrame | None = None) -> DataFrame:
    """Of rows (qid, doc_id, score, pos): each document's best first, then the best of the rest, no document above a fixed cap.

    targets (qid, doc_id) say which documents count; by default those that are there. The limit may be a column over `docs`, the
    number of a question's documents.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    scope = rows.select("qid", "doc_id") if targets is None else targets
    scope = scope.distinct().groupBy("qid").agg(F.count("*").alias("docs"))
    own = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "pos"))
    cap = F.greatest(F.lit(2), F.floor(limit / F.greatest("docs", F.lit(1))) + 1)
    kept = rows.join(scope, "qid").withColumn("own", own).where(F.col("own") <= cap)
    order = Window.partitionBy("qid").orderBy(F.when(F.col("own") == 1, 0).otherwise(1), F.desc("score"), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("docs", "own")


def adaptive(rows: DataFrame, limit: int) -> DataFrame:
    """Of rows (qid, doc_id, pos, score), by score: a document is passed over once it has max(2, limit / documents seen + 1) rows.

    The cap depends on what was taken before, so it is a fold over one question's candidates (168 at most in the default plan).
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        taken, counts = [], {}
        for row in group.sort_values(["score", "pos"], ascending=[False, True]).itertuples():
            held = counts.get(row.doc_id, 0)
            if len(counts) > 1 and held >= max(2, limit // len(counts) + 1):
                continue
            counts[row.doc_id] = held + 1
            taken.append(row.Index)
            if len(taken) >= limit:
                break
        out = group.loc[taken].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("qid").applyInPandas(pick, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", rank int")


def citations(rows: DataFrame, *order: str) -> DataFrame:
    """Numbers the rows of each question E1, E2, ..."""
    return rows.withColumn("citation_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("qid").orderBy(*order))))


def near_duplicates(rows: DataFrame, limit: float = 0.72) -> DataFrame:
    """Of candidates (qid, doc_id, page, pos, text), best first: those kept, without what repeats a better one.

    Two texts of a document and page repeat each other if one contains the other; any two do if both have six or more tokens
    and the smaller set overlaps the larger by the limit. A fold over one question's candidates.
    """

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        index = []
        for row in group.sort_values("pos").itertuples():
            flat = " ".join((row.text or "").lower().split())
            words = set(row.tokens)
            for doc, page, other, had in taken:
                if doc == row.doc_id and page == row.page and (flat in other or other in flat):
                    break
                if min(len(words), len(had)) >= 6 and len(words & had) / min(len(words), len(had)) >= limit:
                    break
            else:
                taken.append((row.doc_id, row.page, flat, words))
                index.append(row.Index)
        return group.loc[index].drop(columns="tokens")

    from ..functions import text as T

    listed = rows.withColumn("tokens", T.tokens(F.col("text")))
    return listed.groupBy("qid").applyInPandas(keep, rows.schema)
