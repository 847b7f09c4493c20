"""A chunk for each role: greedy choices with exclusion across roles, folded over a few candidates of each document or question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import top

#: The order in which roles choose, the score from which a chosen chunk covers a role, and the role that is never covered.
OVERVIEW_ORDER = ("purpose", "approach", "claim", "conclusion", "caveat")
COVERED, NEVER_COVERED = 0.45, "conclusion"
#: The first choice scores .98, each later one .05 less.
FIRST_SCORE, LESS = 0.98, 0.05
DIVERSE_ORDER = ("purpose", "approach", "conclusion", "claim")
EXAMPLES = ["例如", "案例", "设想", "在某高校", "课程中", "论文初稿", "学生在提交"]


def is_noise(text: Column) -> Column:
    """Chunks that stand for no role: front matter, code, hand-in notes, and reference lists with two entries or more."""
    listed = T.is_reference_section(text) & (T.reference_markers(text) >= 2)
    return T.is_front_matter(text) | T.is_code(text) | T.is_submission(text) | listed


def role_chunks(scores: DataFrame, covers: DataFrame, most: int, order: tuple[str, ...] = OVERVIEW_ORDER) -> DataFrame:
    """(doc_id, place, role, chunk_no, score): for an overview of each document the best chunk of one role after the other.

    scores: doc_id, chunk_no, role, score (over 0); covers: doc_id, chunk_no, roles that the chunk covers when chosen. A role that a
    chosen chunk covers is passed over, but for the conclusion; a chunk that another role has chosen isn't chosen again, nor is
    the next best. At most `most` chunks; ties go to the earlier chunk. Each task keeps a document's best chunk of a role before the
    shuffle, so a document of any length comes to as many candidates as there are roles.
    """
    place = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(order)])
    best = top(scores.where(F.col("role").isin(*order)), 1, ["doc_id", "role"], F.round("score", 9), "chunk_no")
    best = best.join(covers.select("doc_id", "chunk_no", "roles"), ["doc_id", "chunk_no"], "left")
    lists = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "role", "chunk_no", F.coalesce("roles", T.empty()).alias("roles")))).alias("found"))
    first = F.expr("named_struct('chosen', CAST(array() AS ARRAY<STRUCT<role: STRING, chunk_no: BIGINT>>), 'covered', CAST(array() AS ARRAY<STRING>))")

    def choose(state: Column, x: Column) -> Column:
        covered = F.array_contains(state["covered"], x["role"]) & (x["role"] != NEVER_COVERED)
        taken = F.exists(state["chosen"], lambda c: c["chunk_no"] == x["chunk_no"])
        adds = ~covered & ~taken & (F.size(state["chosen"]) < most)
        new = F.struct(x["role"].alias("role"), x["chunk_no"].cast("long").alias("chunk_no"))
        return F.struct(F.when(adds, F.array_append(state["chosen"], new)).otherwise(state["chosen"]).alias("chosen"), F.when(adds, F.concat(state["covered"], x["roles"])).otherwise(state["covered"]).alias("covered"))

    chosen = lists.select("doc_id", F.posexplode(F.aggregate("found", first, choose, lambda s: s["chosen"])).alias("place", "x"))
    return chosen.select("doc_id", "place", "x.role", "x.chunk_no", F.least(F.lit(1.0), FIRST_SCORE - LESS * F.col("place")).alias("score"))


def diverse_overview(rows: DataFrame, roles: DataFrame, limit: int, order: tuple[str, ...] = DIVERSE_ORDER, key: str = "doc_id") -> DataFrame:
    """(qid, key, rank, role): of a question's candidates one for each role, then the others in their order, `limit` in all.

    rows: qid, key, pos, bonus (what speaks for a candidate in any role), usable (it may stand for a role), fills (it may follow);
    roles: qid, key, role, score (over 0). A role takes the best of what no earlier one has taken, by score and bonus, then by pos; as
    each earlier role takes one at most, as many candidates as there are roles are enough for each. A question of whose candidates
    none may be taken keeps them all as they are.
    """
    n = len(order)
    scored = rows.where("usable").join(roles.where(F.col("role").isin(*order)), ["qid", key]).withColumn("value", F.round(F.col("score") + F.col("bonus"), 9))
    place = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(order)])
    best = top(scored, n, ["qid", "role"], F.col("value"), "pos").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "rank", "role", F.col(key).alias("item")))).alias("found"))
    kind = rows.schema[key].dataType.simpleString()
    first = F.expr(f"named_struct('items', CAST(array() AS ARRAY<{kind}>), 'roles', CAST(array() AS ARRAY<STRING>))")

    def choose(state: Column, x: Column) -> Column:
        adds = ~F.array_contains(state["roles"], x["role"]) & ~F.array_contains(state["items"], x["item"]) & (F.size(state["items"]) < limit)
        return F.struct(F.when(adds, F.array_append(state["items"], x["item"])).otherwise(state["items"]).alias("items"), F.when(adds, F.array_append(state["roles"], x["role"])).otherwise(state["roles"]).alias("roles"))

    state = F.aggregate("found", first, choose)
    taken = best.select("qid", F.posexplode(F.arrays_zip(state["items"].alias("item"), state["roles"].alias("role"))).alias("place", "x")).select("qid", F.col("x.item").alias(key), "place", "x.role")
    marked = rows.join(taken, ["qid", key], "left")
    any_ = F.max((F.col("place").isNotNull() | F.col("fills")).cast("int")).over(Window.partitionBy("qid"))
    marked = marked.withColumn("any", any_).where(F.col("place").isNotNull() | F.col("fills") | (F.col("any") == 0))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("place").isNull(), "place", "pos"))
    return marked.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", key, "rank", F.coalesce("role", F.lit("")).alias("role"))
