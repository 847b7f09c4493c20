"""Exact top-k inner products by no-random-access (NRA) aggregation over sorted component lists.

Each component of the candidates is a sorted list, read from the end that a query's own component favours. A query reads its
heaviest lists first, each in two sequential parts: down to the middle entry, then the rest. An entry that isn't read yet is at
most the last one read of its list; lists not begun are bounded together by what a candidate's norm leaves (Cauchy-Schwarz). So
each candidate has a lower and an upper bound. One whose upper bound is below the k-th best lower bound can't qualify: nothing of
it is read any more. The k-th bound is carried from block to block. Reading stops for a block when no candidate is left, and
what is left when all lists are read has its final score. As long as most candidates are open, some queries read their lists
together, as matrix products; then each query goes on with what is open for it alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists that are read together between two comparisons of the bounds, and candidates in a block.
STEP, BLOCK = 16, 8192
#: Queries that read together, and the share of open candidates below which each reads alone.
TOGETHER, OPEN = 64, 0.2


class Lists:
    """The sorted lists of a block of candidates, kept as columns with their middle and last entries, and the norms."""

    def __init__(self, ids: np.ndarray, items: np.ndarray, kind: type):
        self.ids, self.v = ids, np.ascontiguousarray(items.T, dtype=kind)
        ordered = np.sort(self.v, axis=1)
        n = ordered.shape[1]
        self.middle = np.stack([ordered[:, (n - 1) // 2], ordered[:, n // 2]])  # read upwards, read downwards
        self.ends = np.stack([ordered[:, 0], ordered[:, -1]])
        self.squares = self.v * self.v
        self.norms = self.squares.sum(axis=0)
        self.upward, self.downward = np.maximum(self.v, self.middle[1][:, None]), np.minimum(self.v, self.middle[0][:, None])


def aggregate(qid: int, query: np.ndarray, lists: Lists, k: int, bound: float, slip: float, counted: bool = False, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(places, scores, bound, entries read if counted): candidates of a block that may be among the k best, with exact scores.

    `bound` is a score that k candidates are known to reach; it comes back as what this block has raised it to. Scores are sums of
    whole numbers and exact; `slip` is more than rounding may change the other side of a bound by. Rows with the query's own id
    are no candidates. `state` (open places, their scores, what is left of their norms, lists read) is where reading goes on.
    """
    open_ = np.flatnonzero(lists.ids != qid)
    open_, score, left, begin = state or (open_, np.zeros(len(open_), lists.v.dtype), lists.norms[open_], 0)
    read, order = 0, np.argsort(-np.abs(query) * (lists.ends[1] - lists.ends[0]), kind="stable")
    for start in range(begin, len(order), STEP):
        if not len(open_):
            break
        some, rest = order[start : start + STEP], np.sqrt((query[order[start + STEP :]] ** 2).sum(dtype=float)).astype(lists.v.dtype)
        w, v = query[some], lists.v[np.ix_(some, open_)]
        if bound > -np.inf or counted:
            # the first part, down to the middle entry: what isn't met there counts as that entry
            side = np.where(w > 0, 1, -1).astype(v.dtype)[:, None]
            toward, least = v * side, np.where(w > 0, lists.middle[1][some], lists.middle[0][some])[:, None] * side
            keep = score + np.abs(w) @ np.maximum(toward, least) + rest * np.sqrt(left) >= bound - slip
            if counted:
                met = toward >= least
                read += np.count_nonzero(met) + np.count_nonzero(~met[:, keep])
            if not keep.all():
                open_, score, left, v = open_[keep], score[keep], left[keep], v[:, keep]
        score, left = score + w @ v, np.maximum(left - np.einsum("ij,ij->j", v, v), 0)
        slack = rest * np.sqrt(left)
        if len(open_) >= k:
            bound = max(bound, float(np.partition(score - slack, len(open_) - k)[len(open_) - k]) - slip)
        keep = score + slack >= bound - slip
        open_, score, left = open_[keep], score[keep], left[keep]
    return open_, score, bound, read


def together(qids: np.ndarray, queries: np.ndarray, lists: Lists, k: int, bound: np.ndarray, slip: float, counted: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """([(places, scores)] by query, bounds, entries read if counted): what `aggregate` gives, for some queries at once."""
    kind, n = lists.v.dtype, len(lists.ids)
    order = np.argsort(-np.abs(queries) * (lists.ends[1] - lists.ends[0]), axis=1, kind="stable")
    open_, score, left, read, row = lists.ids != qids[:, None], np.zeros((len(qids), n), kind), np.repeat(lists.norms[None], len(qids), axis=0), 0, np.arange(len(qids))[:, None]
    begin = 0
    while begin < order.shape[1] and open_.mean() > OPEN:
        some = np.zeros(queries.shape, kind)
        some[row, order[:, begin : begin + STEP]] = 1
        after = np.zeros(queries.shape, kind)
        after[row, order[:, begin + STEP :]] = 1
        w, rest = queries * some, np.sqrt(((queries * after) ** 2).sum(axis=1, dtype=float)).astype(kind)[:, None]
        if counted or (bound > -np.inf).any():
            most = score + np.maximum(w, 0) @ lists.upward + np.minimum(w, 0) @ lists.downward + rest * np.sqrt(left)
            keep = open_ & (most >= (bound - slip)[:, None])
            if counted:
                up = some * (w > 0)
                met = up @ (lists.v >= lists.middle[1][:, None]).astype(kind) + (some - up) @ (lists.v <= lists.middle[0][:, None]).astype(kind)
                read += int(met[open_].sum(dtype=float) + (some.sum(axis=1)[:, None] - met)[keep].sum(dtype=float))
            open_ = keep
        score, left = score + w @ lists.v, np.maximum(left - some @ lists.squares, 0)
        slack = rest * np.sqrt(left)
        least = np.where(open_, score - slack, kind.type(-np.inf))
        raised = np.flatnonzero((least > bound[:, None]).sum(axis=1) >= k)  # fewer than k can't raise a bound
        if len(raised):
            bound[raised] = np.maximum(bound[raised], np.partition(least[raised], n - k, axis=1)[:, n - k].astype(float) - slip)
        open_ &= score + slack >= (bound - slip)[:, None]
        begin += STEP
    found = []
    for i, qid in enumerate(qids):
        at = np.flatnonzero(open_[i])
        at, own, bound[i], more = aggregate(qid, queries[i], lists, k, bound[i], slip, counted, (at, score[i, at], left[i, at], begin))
        found.append((at, own))
        read += more
    return found, bound, read


def nearest(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query ids, item ids, scores, share of list entries read if counted): each query's k best items, ties to the smaller id."""
    top = (float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0))) * max(1, queries.shape[1])
    most = max(top, float(np.abs(items).max(initial=0)) ** 2 * max(1, queries.shape[1]))
    # whole numbers below 2^24 are exact in single precision, below 2^53 in double
    kind, slip = (np.float32, 1e-6 * most + 1e-3) if most < 2**24 else (np.float64, 1e-13 * most + 1e-3)
    blocks = [Lists(ids[at : at + BLOCK], items[at : at + BLOCK], kind) for at in range(0, len(ids), BLOCK)] if most < 2**53 else []
    found, read = [], 0

    def first(qid: int, near: np.ndarray, score: np.ndarray) -> None:
        best = np.lexsort((near, -score))[:k]
        found.append((np.full(len(best), qid), near[best], score[best]))

    if most < 2**53:
        for at in range(0, len(qids), TOGETHER):
            own, few, bound = qids[at : at + TOGETHER], queries[at : at + TOGETHER].astype(kind), np.full(len(qids[at : at + TOGETHER]), -np.inf)
            got: list[list] = [[] for _ in own]
            for lists in blocks:
                each, bound, more = together(own, few, lists, k, bound, slip, counted)
                read += more
                for held, (place, score) in zip(got, each, strict=True):
                    held.append((lists.ids[place], score.astype(np.int64)))
            for qid, held in zip(own, got, strict=True):
                first(qid, *(np.concatenate(x) for x in zip(*held, strict=True)))
    else:  # too large for exact floating point: whole numbers of any size
        for qid, query in zip(qids, queries, strict=True):
            other = ids != qid
            read += items.size
            first(qid, ids[other], np.array([sum(int(a) * int(b) for a, b in zip(query, v)) for v in items[other]], object))
    share = read / max(1, len(qids) * items.size)
    return (*(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3)), share)


def matrix(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors of one length as rows."""
    return ids.to_numpy(), vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def finite(vector: Column) -> Column:
    """True for vectors that hold no null, NaN or infinite component and at least one component."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, query_rows: int = 1024, item_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by the inner product of floor(scale * x).

    Ties go to the smaller id. Vectors that are null, empty or hold a null or non-finite component, and rows without an id,
    take no part; vectors of different lengths aren't compared. Rows that repeat an id are candidates each (not of their own
    id's query), and one query (the one whose vector sorts first). Parts of about query_rows queries and item_rows candidates
    meet once, each pair in a task of its own, so a row is sent once for each part of the other side; k rows a query come back.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(vector_col).alias("dims"), is_query.alias("asks"))
    asked = rows.where("asks").groupBy("id").agg(F.min(F.struct("dims", "v")).alias("row")).select("id", "row.v", "row.dims")
    parts = rows.groupBy("dims").agg(F.ceil(F.count("*") / item_rows).alias("groups"), F.greatest(F.ceil(F.count_if("asks") / query_rows), F.lit(1)).alias("turns"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    items = rows.join(parts, "dims").select("dims", "id", "v", dealt("groups").alias("part"), each_of("turns").alias("turn"))
    queries = asked.join(parts, "dims").select(F.col("dims").alias("q_dims"), dealt("turns").alias("q_turn"), each_of("groups").alias("q_part"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))

    def meet(asks: pa.Table, given: pa.Table) -> pa.Table:
        if not asks.num_rows or not given.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        q, i, score, _ = nearest(*matrix(asks.column("q_id"), asks.column("q_v")), *matrix(given.column("id"), given.column("v")), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(score, pa.int64())})

    found = queries.groupBy("q_dims", "q_turn", "q_part").cogroup(items.groupBy("dims", "turn", "part")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
