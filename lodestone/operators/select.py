"""Which candidates go on: merging expanded units, covering documents and roles, and the facts of a conversation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fuse import distinct_text, first_of

#: What finer pieces of text are worth beside their score.
GRANULARITY = {"sentence": 0.035, "table_row": 0.03, "neighbour": 0.02}


def merge_units(candidates: DataFrame, local: DataFrame, limit: int, share: float = 0.65) -> DataFrame:
    """Candidates and expanded units (both: qid, doc_id, chunk_id, kind, score, pos, text) by score, granularity and position.

    Of equal texts the first stays; units from expansion fill at most `share` of the limit.
    """
    bonus = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in GRANULARITY.items()], F.lit(0.0))
    rows = candidates.withColumn("own", F.lit(False)).unionByName(local.withColumn("own", F.lit(True)))
    rows = rows.withColumn("order", F.col("score") + bonus).withColumn("_key", distinct_text(F.col("text"))).withColumn("_neg", -F.col("order"))
    rows = first_of(rows, ["qid", "_key"], "_neg", "pos").drop("_key", "_neg")
    place = F.row_number().over(Window.partitionBy("qid", "own").orderBy(F.desc("order"), "pos"))
    rows = rows.withColumn("place", place).where(~F.col("own") | (F.col("place") <= int(limit * share)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("order"), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("own", "place", "order")


def cover_documents(selected: DataFrame, candidates: DataFrame, scope: DataFrame, limit: int, least: float = 1.15, relevance: float = 0.12) -> DataFrame:
    """selected (qid, doc_id, chunk_id, score, relevance, pos) with the best candidate of each scoped document (qid, doc_id) that
    has none yet, if it is good enough; one row of each document is kept before the limit cuts."""
    missing = scope.join(selected, ["qid", "doc_id"], "left_anti")
    good = candidates.join(missing, ["qid", "doc_id"], "left_semi").where((F.col("score") >= least) | (F.col("relevance") >= relevance))
    best = first_of(good.withColumn("_neg", -F.col("score")), ["qid", "doc_id"], "_neg", "pos").drop("_neg")
    rows = selected.unionByName(best.select(*selected.columns))
    own = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "pos"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.when(F.col("own") == 1, 0).otherwise(1), F.desc("score"), "pos"))
    return rows.withColumn("own", own).withColumn("rank", rank).where(F.col("rank") <= limit).drop("own")


def cover_roles(selected: DataFrame, candidates: DataFrame, roles: DataFrame, limit: int, most: int = 3) -> DataFrame:
    """selected (qid, doc_id, chunk_id, score, pos) repaired so that each of a question's first roles (qid, role_no, terms) is met
    by some text: the best candidate with a term comes first, and the lowest row leaves if there are too many.

    A fold over one question's rows; candidates and selected carry `text`.
    """
    schema = selected.select("qid", "doc_id", "chunk_id", "score", "pos", "text").schema
    asked = roles.where(F.col("role_no") < most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("role_no", "terms"))).alias("roles"))
    both = selected.select(*schema.names).withColumn("in", F.lit(True)).unionByName(candidates.select(*schema.names).join(selected.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").select(*schema.names).withColumn("in", F.lit(False)))

    def repair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        rows, rest = group[group["in"]].to_dict("records"), group[~group["in"]].to_dict("records")
        met = lambda row, terms: sum(t.lower() in (row["text"] or "").lower() for t in terms)
        for role in group["roles"].iloc[0] if group["roles"].iloc[0] is not None else []:
            if any(met(row, role["terms"]) for row in rows):
                continue
            best = max(rest, key=lambda row, t=role["terms"]: (met(row, t) + 0.4 * row["score"]) if met(row, t) else -1, default=None)
            if best is None or not met(best, role["terms"]):
                continue
            if len(rows) >= limit:
                rows.remove(min(rows, key=lambda row: row["score"]))
            rest.remove(best)
            rows.insert(0, best)
        return pd.DataFrame(rows[:limit], columns=schema.names)

    return both.join(asked, "qid", "left").groupBy("qid").applyInPandas(repair, schema)


def facts(items: DataFrame, legacy: DataFrame) -> DataFrame:
    """(conv_id, facts: map): a conversation's facts (conv_id, key, value), memory items over older ones."""
    rows = legacy.select("conv_id", "key", "value", F.lit(0).alias("age")).unionByName(items.select("conv_id", "key", "value", F.lit(1).alias("age")))
    last = rows.groupBy("conv_id", "key").agg(F.max_by("value", "age").alias("value"))
    return last.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))
