"""SimHash near-duplicates: Hamming links found with a hierarchical index over Gray-ordered fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Children of an index node.
FANOUT = 8


def fingerprint(text: bytes | None, words_each: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; zero where the text has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(words_each, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(lengths)])
    votes, n, digest = np.zeros(BITS, np.int64), len(words) - size + 1, xxhash.xxh64_intdigest
    heads, tails = start[:n].tolist(), (start[size : size + n] - 1).tolist()
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(heads[k : k + (1 << 16)], tails[k : k + (1 << 16)], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long, version long) of every whole text; version is a hash of the text as it is."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], ["doc_id", "fp", "version"])

    return common.by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), _version(text_col).alias("version")), each, "doc_id long, fp long, version long")


def _version(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


# ------------------------------------------------------------------ index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray sequence, where neighbours differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """An index over several cells of fingerprints at once; rows are sorted by (cell, Gray rank).

    A node stands for up to FANOUT consecutive entries below it. It keeps the bits on which all of them agree: their mask
    and pattern, without those that its own parent already fixes. A search adds up differences on the way down and leaves a
    whole group as soon as the sum is over the limit.
    """

    def __init__(self, fp: np.ndarray, cell: np.ndarray):
        self.fp = fp
        ones, zeros, levels = fp, ~fp, []
        while True:
            fresh = np.concatenate([[True], cell[1:] != cell[:-1]])
            head = np.flatnonzero(fresh)
            place = np.arange(len(cell)) - np.repeat(head, np.diff(np.append(head, len(cell))))
            begin = np.flatnonzero(place % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, begin), np.bitwise_and.reduceat(zeros, begin)
            levels.append((begin, np.append(begin[1:], len(cell)), ones, ones | zeros))
            cell = cell[begin]
            if len(cell) == len(head):
                break
        self.levels, self.roots = levels, cell

    def links(self, query: np.ndarray, root: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (q, i) with q < i, i below the query's root, and at most `limit` bits between them."""
        q, node, fixed, sum_ = query, root, np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint8)
        for begin, end, ones, mask in reversed(self.levels):
            sum_ = sum_ + np.bitwise_count((self.fp[q] ^ ones[node]) & mask[node] & ~fixed)
            keep = (sum_ <= limit)
            q, node, sum_ = q[keep], node[keep], sum_[keep]
            count = end[node] - begin[node]
            fixed = np.repeat(mask[node], count)
            child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[node], count)
            q, sum_, node = np.repeat(q, count), np.repeat(sum_, count), child
        later = node > q
        q, node, fixed, sum_ = q[later], node[later], fixed[later], sum_[later]
        near = sum_ + np.bitwise_count((self.fp[q] ^ self.fp[node]) & ~fixed) <= limit
        return q[near], node[near]


def cell_links(fp: np.ndarray, cell: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each cell, all fingerprints that are connected there; as stars, not all pairs."""
    order = np.lexsort((gray_rank(fp), cell))
    fp, cell = fp[order], cell[order]
    index = GrayIndex(fp, cell)
    root = np.searchsorted(index.roots, cell)
    label = np.arange(len(fp))
    for k in range(0, len(fp), 2048):
        q = np.arange(k, min(k + 2048, len(fp)))
        a, b = index.links(q, root[q], limit)
        label = common.local_components(np.concatenate([a, np.arange(len(fp))]), np.concatenate([b, label]), len(fp))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


def masks(level: int, parts: int) -> list[int]:
    """The bits fixed at the top of the index: level 0 cuts 64 bits into parts, each further level cuts what is left free.

    Two fingerprints with fewer than `parts` differences agree on at least one part of each cut, so they meet below a node.
    """
    out = [0]
    for _ in range(level + 1):
        out = [m | sum(1 << int(b) for b in piece) for m in out for piece in np.array_split([b for b in range(BITS) if not m >> b & 1], parts)]
    return out


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def link_edges(prints: DataFrame, limit: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within `limit` bits.

    Below each top-level node lies a cell of fingerprints that agree on its bits. Cells over cell_rows are cut by a further
    level until none is left, so a task never holds more than one bounded cell; nothing is dropped.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def work(path, value, fp):
            if not len(fp):
                return
            fresh = np.concatenate([[0], np.cumsum((path[1:] != path[:-1]) | (value[1:] != value[:-1]))])
            a, b = cell_links(fp.view(np.uint64), fresh, limit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True)]
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])  # its cell may go on in the next batch
            rest = [r[last] for r in rows]
            yield from work(*(r[~last] for r in rows))
        yield from work(*rest)

    found, todo, level = [], prints.select("fp"), 0
    while True:
        top = masks(level, limit + 1)
        cut = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(top)])
        if level == 0:
            cells = todo.select("fp", F.inline(cut))
        else:  # only the cuts below a cell that was too large
            cells = todo.select("fp", F.inline(F.filter(cut, lambda c: F.floor(c["path"] / (limit + 1)) == F.col("cell_path"))))
        cells = cells.drop("mask")
        large = common.saved(cells.groupBy("path", "value").count().where(F.col("count") > cell_rows).drop("count"), "cells")
        some = large.count()
        last = not some or level == 5  # so deep, a cell of limit 3 has 12 free bits; with other limits large cells are searched as they are
        fit = cells if last else cells.join(common.small_side(large, some), ["path", "value"], "left_anti")
        fit = fit.select(F.col("path").cast("long"), "value", "fp").repartition("path", "value").sortWithinPartitions("path", "value")
        found.append(fit.mapInArrow(joined, "a long, b long"))
        if last:
            break
        todo = cells.join(common.small_side(large, some), ["path", "value"], "left_semi").select("fp", F.col("path").alias("cell_path"))
        todo, level = common.saved(todo, "todo"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, version) of every row, and (fp, component_id, root) of every fingerprint."""
    prints = common.saved(fingerprints(docs, id_col, text_col), "prints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = common.components(link_edges(groups, limit))
    named = groups.join(nodes, groups["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = common.saved(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints, named.join(least, "root").select("fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 3) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component the row with the smallest id, once.

    Rows without words share fingerprint zero, so one of them stays. Rows that repeat an id and a text count once; of different
    texts with the smallest id of one component, that with the smallest hash stays. Rows with a null id stay. Texts are shuffled
    only for rows that are repeated, and where there are more copies than a broadcast may hold.
    """
    prints, named = _grouped(docs, id_col, text_col, limit)
    placed = prints.where("doc_id is not null").join(named, "fp")
    heads = placed.where("doc_id = component_id").groupBy("root").agg(F.min("version").alias("head"))
    gone = placed.join(heads, "root").where("doc_id <> component_id or version <> head").select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct()
    gone = common.saved(gone, "gone")
    twice = prints.where("doc_id is not null").groupBy("doc_id", "version").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("version").alias("twice_version"))
    twice = common.saved(twice.join(gone, (F.col("twice_id") == F.col("gone_id")) & (F.col("twice_version") == F.col("gone_version")), "left_anti"), "twice")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), _version(text_col).alias("version"))
    rows = rows.join(common.small_side(gone, gone.count()), (F.col("id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left_anti")
    if not (some := twice.count()):
        return rows.select("row.*")
    same = (F.col("id") == F.col("twice_id")) & (F.col("version") == F.col("twice_version"))
    once = F.row_number().over(Window.partitionBy("id", "version").orderBy("version"))
    many = rows.join(common.small_side(twice, some), same, "left_semi").withColumn("n", once).where("n = 1").select("row.*")
    return rows.join(common.small_side(twice, some), same, "left_anti").select("row.*").unionByName(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows that share an id each keep their own
    fingerprint. A null id never becomes a component's name; a component of null ids only has the name null.
    """
    prints, named = _grouped(docs, id_col, text_col, limit)
    out = prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out
