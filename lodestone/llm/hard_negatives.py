"""Hard negatives by an STR-packed R-tree: rows of other labels whose inner product lies in a window below a positive's.

Rows are dealt by label into parts of bounded size, so a hot label is several parts. Each part is packed by Sort-Tile-Recursive
into leaves of near rows, leaves into nodes, and each box keeps its least and largest components. With a query's components, a box
bounds the inner products of all rows in it from both sides. A queue hands out the box with the best bound first; boxes that no
open window meets, or whose bound is strictly below the k-th best found, are left out whole. A first pass over the parts of
an anchor's own label gives its positives, a second one over the other parts fills the windows that their scores open.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .topk import finite, matrix

#: Rows in a leaf, boxes in a node.
LEAF, FAN = 128, 16


def str_order(items: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of rows in which each run of `leaf` rows is one tile: sorted and cut by one component after the other, the most
    varied first, into as many slices each as leaves need."""
    by_spread = np.argsort(-items.var(axis=0), kind="stable") if len(items) else np.zeros(0, int)

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        rows = rows[np.argsort(items[rows, by_spread[depth]], kind="stable")]
        left = len(by_spread) - depth
        if pages <= 1 or left == 1:
            return [rows]
        slices = int(np.ceil(pages ** (1 / left)))
        step = leaf * -(-pages // slices)
        return [x for k in range(0, len(rows), step) for x in tile(rows[k : k + step], depth + 1)]

    return np.concatenate(tile(np.arange(len(items)), 0)) if len(items) else np.zeros(0, int)


class Tree:
    """A packed tree over whole numbers held as doubles: `levels` of boxes (low, high) from the root's children to the leaves."""

    def __init__(self, ids: np.ndarray, items: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = str_order(items, leaf)
        self.ids, self.items, self.leaf, self.fan = ids[order], items[order], leaf, fan
        cut = np.arange(0, len(ids), leaf)
        self.levels = [(np.minimum.reduceat(self.items, cut, axis=0), np.maximum.reduceat(self.items, cut, axis=0))]
        while len(self.levels[0][0]) > fan:
            low, high = self.levels[0]
            cut = np.arange(0, len(low), fan)
            self.levels.insert(0, (np.minimum.reduceat(low, cut, axis=0), np.maximum.reduceat(high, cut, axis=0)))

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level the lowest and highest inner products, queries x boxes."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return [(plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T) for low, high in self.levels]

    def search(self, query: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, tops: np.ndarray, k: int, but: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """(of each window its k best ids and scores, rows read): scores of a window are from floors to tops, ties to the smaller id.

        `bounds` are one query's. Rows with the id `but` are left out.
        """
        n = len(floors)
        best = [(np.zeros(0, self.ids.dtype), np.zeros(0)) for _ in range(n)]
        kth, read = np.full(n, -np.inf), 0

        def wanted(level: int, start: int, stop: int) -> list[tuple[float, int, int]]:
            low, high = (x[start:stop] for x in bounds[level])
            reach = np.minimum(high[:, None], tops)
            open_ = (low[:, None] <= tops) & (high[:, None] >= floors) & (reach >= kth)
            return [(-reach[i][open_[i]].max(), level, start + i) for i in np.flatnonzero(open_.any(axis=1)).tolist()]

        queue = wanted(0, 0, len(self.levels[0][0])) if n else []
        heapq.heapify(queue)
        while queue:
            _, level, box = heapq.heappop(queue)
            low, high = bounds[level][0][box], bounds[level][1][box]
            if not ((low <= tops) & (high >= floors) & (np.minimum(high, tops) >= kth)).any():
                continue
            if level < len(self.levels) - 1:
                for entry in wanted(level + 1, box * self.fan, (box + 1) * self.fan):
                    heapq.heappush(queue, entry)
                continue
            rows = slice(box * self.leaf, (box + 1) * self.leaf)
            ids, score = self.ids[rows], self.items[rows] @ query
            read += len(ids)
            fits = (score >= np.maximum(floors, kth)[:, None]) & (score <= tops[:, None])
            if but is not None:
                fits &= ids != but
            for w in np.flatnonzero(fits.any(axis=1)).tolist():
                i, s = np.concatenate([best[w][0], ids[fits[w]]]), np.concatenate([best[w][1], score[fits[w]]])
                first = np.lexsort((i, -s))[:k]
                best[w] = i[first], s[first]
                if len(first) == k:
                    kth[w] = s[first[-1]]
        return best, read


def _exact(query: np.ndarray, ids: np.ndarray, items: np.ndarray, floors: list, tops: list, k: int, but: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same over numbers too large for doubles, row by row in whole numbers of any size."""
    score = np.array([sum(int(a) * int(b) for a, b in zip(query, v, strict=True)) for v in items], object)
    out = []
    for low, high in zip(floors, tops, strict=True):
        fits = np.flatnonzero((score >= low) & (score <= high) & (ids != but if but is not None else True))
        first = fits[np.lexsort((ids[fits], -score[fits]))[:k]]
        out.append((ids[first], score[first]))
    return out


def within(qids: np.ndarray, queries: np.ndarray, windows: list[tuple[list, list]], ids: np.ndarray, items: np.ndarray, k: int, own: bool) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], float]:
    """([(query's place, window, ids, scores)], share of rows read) of one part; queries don't find their own id if `own`."""
    found, read = [], 0
    size = max(float(np.abs(queries).max(initial=0)), float(np.abs(items).max(initial=0)))
    if 100 * size * size * max(1, items.shape[1]) >= 2**53:
        for q, (floors, tops) in enumerate(windows):
            best = _exact(queries[q], ids, items, floors, tops, k, int(qids[q]) if own else None)
            found += [(q, w, i, s) for w, (i, s) in enumerate(best) if len(i)]
        return found, 1.0
    tree, queries = Tree(ids, items.astype(float)), queries.astype(float)
    bounds = tree.bounds(queries)
    for q, (floors, tops) in enumerate(windows):
        best, more = tree.search(queries[q], [(low[q], high[q]) for low, high in bounds], np.array(floors, float), np.array(tops, float), k, int(qids[q]) if own else None)
        read += more
        found += [(q, w, i, s) for w, (i, s) in enumerate(best) if len(i)]
    return found, read / max(1, len(qids) * len(ids))


def _searched(queries: DataFrame, parts: DataFrame, items: DataFrame, k: int, own: bool, query_rows: int) -> DataFrame:
    """(anchor_id, place, found_id, score): each query (anchor_id, label, dims, v, windows) against the parts of its own label, or
    of all others. Every part meets every block of about query_rows queries in a task of its own."""
    turns = common.saved(queries.groupBy("dims").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / query_rows)).alias("turns")), "turns")
    few = turns.count()
    dealt = queries.join(common.small_side(turns, few), "dims")
    asked = dealt.select("anchor_id", F.col("label").alias("own"), F.col("dims").alias("q_dims"), "v", "windows", F.pmod(F.xxhash64("anchor_id"), "turns").alias("q_turn"))
    here = parts.select(F.col("label").alias("q_label"), F.col("dims").alias("p_dims"), F.col("part").alias("q_part"))
    same = F.col("own") == F.col("q_label")
    asked = asked.join(common.small_side(here, parts.count()), (F.col("q_dims") == F.col("p_dims")) & (same if own else ~same)).drop("own", "p_dims")
    each_turn = turns.select(F.col("dims").alias("t_dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))
    met = items.join(common.small_side(each_turn, few), F.col("dims") == F.col("t_dims")).select("label", "dims", "part", "turn", "id", F.col("v").alias("item"))

    def meet(asks: pa.Table, given: pa.Table) -> pa.Table:
        names = ("anchor_id", "place", "found_id", "score")
        if not asks.num_rows or not given.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        qids, query = matrix(asks.column("anchor_id"), asks.column("v"))
        # 30 p <= 100 n <= 90 p in whole numbers
        windows = [([-np.inf], [np.inf]) if s is None else ([-(-30 * p // 100) for p in s], [90 * p // 100 for p in s]) for s in asks.column("windows").to_pylist()]
        found, _ = within(qids, query, windows, *matrix(given.column("id"), given.column("item")), k, own)
        cols = [np.concatenate([np.full(len(i), qids[q]) for q, _, i, _ in found]), np.concatenate([np.full(len(i), w) for _, w, i, _ in found]), np.concatenate([i for *_, i, _ in found]), np.concatenate([s for *_, s in found])] if found else [np.zeros(0)] * 4
        return pa.table({n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(names, cols, strict=True)})

    groups = asked.groupBy("q_label", "q_dims", "q_part", "q_turn").cogroup(met.groupBy("label", "dims", "part", "turn"))
    return groups.applyInArrow(meet, "anchor_id long, place long, found_id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, scale: int = 256, part_rows: int = 16384, query_rows: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor and positive the hard negatives.

    Scores are inner products of floor(scale * x); a positive is one of the anchor's first other rows of its label, a negative a
    row of another label with 30 % to 90 % of the positive's score, best first, ties to the smaller id. Rows without an id or a
    label and vectors that are null, empty or hold a null or non-finite component take no part; vectors of different lengths aren't
    compared. Rows that repeat an id are candidates each (not of their own id's anchor), and one anchor (the least label and vector).
    An anchor without positives, or a positive without negatives, gives no row. Scores of more than 64 bits are an error.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & finite(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"), F.size(vector_col).alias("dims"), is_anchor.alias("asks"))
    counts = common.saved(rows.groupBy("label", "dims").agg(F.ceil(F.count("*") / part_rows).alias("groups")), "labels")
    items = common.saved(rows.join(common.small_side(counts, counts.count()), ["label", "dims"]).select("label", "dims", F.pmod(F.xxhash64("id"), "groups").alias("part"), "id", "v", "asks"), "negatives")
    parts = common.saved(items.select("label", "dims", "part").distinct(), "parts")
    anchors = items.where("asks").groupBy("id").agg(F.min(F.struct("label", "dims", "v")).alias("row")).select(F.col("id").alias("anchor_id"), "row.*")

    anchors = common.saved(anchors, "anchors")
    near = _searched(anchors.withColumn("windows", F.lit(None).cast("array<long>")), parts, items.drop("asks"), positives, True, query_rows)
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id"))
    near = common.saved(near.withColumn("place", order.cast("long") - 1).where(F.col("place") < positives), "positives")
    windows = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("windows"))
    found = _searched(anchors.join(windows, "anchor_id"), parts, items.drop("asks"), negatives, False, query_rows)
    order = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "found_id"))
    found = found.withColumn("rank", order).where(F.col("rank") <= negatives).select("anchor_id", "place", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", "place", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
