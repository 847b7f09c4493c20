"""Approximate nearest vectors: tables of hyperplane codes as join keys, so that only vectors that share a code are multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import search

_PAIRS = "qid {q}, item_id {i}, score double"


def _usable(vector: Column, dims: int) -> Column:
    """Vectors of the asked length, all finite and not all zero."""
    return (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _coded(rows: DataFrame, key: str, dims: int, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """(key, embedding, codes): unit vectors and of each table the codes to look under, `probes` of them: the vector's own and those
    next to it by the squared distances to the planes that lie between."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dims))
    turned = (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                side = (x @ planes.T).reshape(len(x), tables, bits)
                own = (side > 0) @ (1 << np.arange(bits))
                codes = own[:, :, None]
                if probes > 1:
                    near = [np.argpartition(side[:, t] ** 2 @ turned.T, min(probes, 1 << bits) - 1, axis=1)[:, :probes] for t in range(tables)]
                    codes = np.stack(near, axis=1) ^ codes
                width = codes.shape[2]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, width, np.int32)), pa.array(codes.reshape(-1).astype(np.int32)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * tables + 1, tables, np.int32)), inner)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, outer], [key, "embedding", "codes"])

    good = rows.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding"), dims))
    return good.mapInArrow(run, f"{key} {good.schema[key].dataType.simpleString()}, embedding array<double>, codes array<array<int>>")


def _listed(coded: DataFrame, key: str) -> DataFrame:
    """(key, tab, code): every code that a row stands under or asks for."""
    return coded.select(key, F.posexplode("codes").alias("tab", "codes")).select(key, "tab", F.explode("codes").alias("code"))


def shared_codes(queries: DataFrame, items: DataFrame, dims: int, tables: int = 8, bits: int = 12, probes: int = 256, seed: int = 11) -> tuple[int, int]:
    """(pairs, products): pairs of a question and an item that share a code of some table, and how often they do. For reports."""
    asked = _listed(_coded(queries, "qid", dims, tables, bits, probes, seed), "qid")
    met = asked.join(_listed(_coded(items, "item_id", dims, tables, bits, 1, seed), "item_id"), ["tab", "code"])
    row = met.groupBy("qid", "item_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("products")).head()
    return row["pairs"], row["products"]


def _best(q: np.ndarray, i: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different items of each question, ties to the smaller item."""
    order = np.lexsort((i, -score, q))
    q, i = q[order], i[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order, q = order[fresh], q[fresh]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[nth < k]


def lsh_top_k(queries: DataFrame, items: DataFrame, k: int, dims: int, tables: int = 8, bits: int = 12, probes: int = 256, seed: int = 11, part_rows: int = 16_384, query_rows: int = 4_096) -> DataFrame:
    """(qid, rank, item_id, score): as search.dense_top_k, but a question meets only the items that stand under one of its codes.

    Queries (qid, embedding), items (item_id, embedding). An item stands under one code of `bits` signs in each of `tables` tables; a
    question asks for the `probes` codes nearest to it. Codes are dealt in runs of about part_rows items, a code with more items is
    several parts; a task holds one part and at most query_rows questions and multiplies only what shares a code. Recall is below 1 and
    grows with tables and probes. A question that finds fewer than k items is asked again without the index. Vectors of another
    length, null, zero or not finite, take no part; rows that repeat an id count once.
    """
    asked = saved(_coded(queries, "qid", dims, tables, bits, probes, seed), "asked")
    stored = saved(_coded(items, "item_id", dims, tables, bits, 1, seed), "stored")
    q_kind, i_kind = asked.schema["qid"].dataType.simpleString(), stored.schema["item_id"].dataType.simpleString()
    schema = _PAIRS.format(q=q_kind, i=i_kind)

    # how codes are dealt: at most tables x 2^bits rows, whatever the number of items
    counts = {(r["tab"], r["code"]): r["n"] for r in _listed(stored, "item_id").groupBy("tab", "code").agg(F.count("*").alias("n")).toLocalIterator()}
    runs, run, filled = [], 0, 0
    for tab, code in sorted(counts):
        n = counts[tab, code]
        if filled and (filled + n > part_rows or runs[-1][0] != tab):
            run, filled = run + 1, 0
        runs.append((tab, code, run, max(1, -(-n // part_rows))))
        filled += n
    deal = F.broadcast(queries.sparkSession.createDataFrame(runs, "tab int, code int, run int, parts int"))
    turns = max(1, -(-asked.count() // query_rows))

    dealt = lambda rows, key: _listed(rows, key).join(deal, ["tab", "code"])
    wants = dealt(asked, "qid").groupBy("qid", "run").agg(F.collect_list("code").alias("wants"), F.max("parts").alias("parts"))
    wants = wants.select("qid", F.col("run").alias("q_run"), "wants", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"))
    wants = wants.join(asked.select("qid", F.col("embedding").alias("q")), "qid").withColumn("q_turn", F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"))
    held = stored.select("item_id", "embedding", F.posexplode(F.flatten("codes")).alias("tab", "code")).join(deal, ["tab", "code"])
    held = held.select("item_id", "embedding", "code", "run", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def meet(asks: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        if asks.num_rows and given.num_rows:
            matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            query, item, code = matrix(asks.column("q")), matrix(given.column("embedding")), given.column("code").to_numpy()
            lists = asks.column("wants").combine_chunks()
            want, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(query)), np.diff(lists.offsets.to_numpy()))
            by_code, by_want = np.argsort(code, kind="stable"), np.argsort(want, kind="stable")
            code, want, of = code[by_code], want[by_want], of[by_want]
            for c in np.unique(code):
                q = of[slice(*np.searchsorted(want, (c, c + 1)))]
                if not len(q):
                    continue
                i = by_code[slice(*np.searchsorted(code, (c, c + 1)))]
                score = np.maximum(0, query[q] @ item[i].T)
                if len(i) > k:  # all that may be among the k best, ties too
                    keep = score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] - 1e-9
                    a, b = np.nonzero(keep)
                    found.append((q[a], i[b], score[a, b]))
                else:
                    found.append((np.repeat(q, len(i)), np.tile(i, len(q)), score.reshape(-1)))
        q, i, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ids = given.column("item_id").to_numpy()[i] if len(i) else i
        best = _best(q, ids, score, k)
        return pa.table({"qid": asks.column("qid").take(pa.array(q[best])), "item_id": given.column("item_id").take(pa.array(i[best])), "score": pa.array(score[best])})

    met = wants.groupBy("q_run", "q_part", "q_turn").cogroup(held.groupBy("run", "part", "turn")).applyInArrow(meet, schema)
    once = saved(met.groupBy("qid", "item_id").agg(F.max("score").alias("score")), "met")
    few = asked.select("qid").distinct().join(once.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k), "qid", "left_anti")
    few = saved(few, "few")
    if few.count():
        again = search.dense_top_k(asked.select("qid", "embedding").join(few, "qid", "left_semi"), stored.select("item_id", "embedding"), k)
        once = once.join(few, "qid", "left_anti").unionByName(again.select("qid", "item_id", "score"))
    return search.top(once, k, "qid", F.col("score"), "item_id").select("qid", "rank", "item_id", "score")
