"""Removal of repeated passages, found with difference-cover anchors.

Positions of a text are counted in words. A difference cover D modulo v holds, for any two offsets, a shift that brings both
into D. So of two equal windows of `window` words, wherever each begins, some run of `window - v + 1` words begins at a cover
position in both texts: an anchor. Anchors are hashed at cover positions only (3 of 7). An anchor that two documents share is
extended to each window that the words to its left and right make with it; these are compared with those that other documents
make, by two hashes of 64 bits, each over all words of the window and its own hash of every word. No match is missed; that two
different windows agree in both isn't to be expected in 1e18 windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Words, mix, sequence_hash

#: Of each period the smallest known difference cover.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Bits of one piece of the anchor filter, and the largest filter that is ever broadcast (256 MB).
PIECE_BITS, MOST_BITS = 20, 31


def _anchors(batch: pa.RecordBatch, window: int, period: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch's texts (last column), the places of anchors among them, and the anchors' hashes."""
    words, size = Words(batch.column(batch.num_columns - 1), exact=True), window - period + 1
    index = words.index()
    left = np.diff(words.bound)[words.rows()] - index
    at = np.flatnonzero(np.isin(index % period, COVERS[period]) & (left >= size))
    return words, at, sequence_hash(words.hash, size, 1)[at] if len(at) else np.zeros(0, np.uint64)


def shared_anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(h): hashes of the anchors that stand in two documents or more; equal anchors meet in each map task first."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at, h = _anchors(batch, window, period)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(words.rows()[at]))], ["h", "doc_id"])

    found = common.by_batch(docs.select("doc_id", "text"), each, "h long, doc_id long")
    return found.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")


def anchor_filter(shared: DataFrame) -> np.ndarray:
    """A bit table with two bits per shared anchor, of at most 2^MOST_BITS bits whatever their number.

    A foreign anchor that passes it costs time only: the windows around it are compared all the same.
    """
    bits = min(MOST_BITS, max(PIECE_BITS, (16 * shared.count()).bit_length()))
    last = F.lit((1 << bits) - 1)
    spots = shared.select(F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftrightunsigned("h", 32).bitwiseAND(last))).alias("bit")).distinct()

    def piece(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << PIECE_BITS, np.uint8)
        own[rows["bit"].to_numpy() & ((1 << PIECE_BITS) - 1)] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros(1 << (bits - 3), np.uint8).reshape(-1, 1 << (PIECE_BITS - 3))
    for row in spots.groupBy(F.shiftright("bit", PIECE_BITS).alias("piece")).applyInArrow(piece, "piece long, bits binary").toLocalIterator():
        table[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _passes(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    out, last = np.ones(len(h), bool), np.uint64(len(table) * 8 - 1)
    for spot in (h & last, (h >> np.uint64(32)) & last):
        out &= (table[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _windows(batch: pa.RecordBatch, window: int, period: int, table: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch's texts (last column), where windows begin that extend an anchor of the filter, and 2 x 64 bits of each."""
    words, at, h = _anchors(batch, window, period)
    at, n = at[_passes(h, table)], len(words.start)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(at - (period - 1), 0), 1)
    np.add.at(change, at + 1, -1)
    left = np.diff(words.bound)[words.rows()] - words.index()
    start = np.flatnonzero((np.cumsum(change[:n]) > 0) & (left >= window))
    hashes = [sequence_hash(h, window, seed)[start] if len(start) else np.zeros(0, np.uint64) for seed, h in ((2, words.hash), (3, words.second))]
    return words, start, np.stack(hashes)


def first_windows(docs: DataFrame, window: int, period: int, table: Broadcast) -> DataFrame:
    """(doc_id, firsts): of each document the hashes of those candidate windows that no document with a smaller id has.

    Equal windows meet by 128 bits, in each map task first; of each only the smallest id goes on.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, start, w = _windows(batch, window, period, table.value)
        of = pa.array(words.rows()[start])
        return pa.RecordBatch.from_arrays([pa.array(w[0].view(np.int64)), pa.array(w[1].view(np.int64)), batch.column(0).take(of)], ["w1", "w2", "doc_id"])

    found = common.by_batch(docs.select("doc_id", "text"), each, "w1 long, w2 long, doc_id long")
    return found.groupBy("w1", "w2").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("w1", "w2")).alias("firsts"))


def _among(first: np.ndarray, second: np.ndarray, known_first: np.ndarray, known_second: np.ndarray) -> np.ndarray:
    """Which pairs of 64-bit numbers are among the known pairs."""
    order = np.argsort(known_first)
    known_first, known_second = known_first[order], known_second[order]
    low, high = np.searchsorted(known_first, first), np.searchsorted(known_first, first, "right")
    one, out = high - low == 1, np.zeros(len(first), bool)
    out[one] = known_second[low[one]] == second[one]
    for k in np.flatnonzero(high - low > 1):
        out[k] = second[k] in known_second[low[k] : high[k]]
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the kept words, joined by one space).

    A word goes if a window over it also begins in a document with a smaller id. Windows are judged on the input, so removals
    don't depend on each other. Null texts have no words; a row without an id loses nothing and takes nothing from others; rows
    that share an id are one document with several texts, which don't take from each other. Bytes that aren't UTF-8 stay as they are.

    Of each window that anchors have found, just the first document is sent back, and texts are read a third time: a window is
    a repeat if its hash isn't among those that its own document has first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    named = docs.where("doc_id is not null and text is not null")
    shared = common.saved(shared_anchors(named, window, period), "anchors")
    table = spark.sparkContext.broadcast(anchor_filter(shared))
    firsts = common.saved(first_windows(named, window, period, table), "firsts")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, start, w = _windows(batch, window, period, table.value)
        own, total = words.rows(), np.diff(words.bound)
        firsts = batch.column(1)
        count = pc.fill_null(pc.list_value_length(firsts), 0).to_numpy(zero_copy_only=False)
        # 128 bits of a window together with its text's row
        rows, of = own[start].astype(np.uint64), np.repeat(np.arange(len(count), dtype=np.uint64), count)
        keys = []
        with np.errstate(over="ignore"):
            for k, (mine, theirs) in enumerate(zip(w, firsts.flatten().flatten(), strict=True)):
                factor = np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                keys.append((mix(mine + rows * factor), mix(theirs.to_numpy().view(np.uint64) + of * factor)))
        known = _among(keys[0][0], keys[1][0], keys[0][1], keys[1][1])
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        start = start[~known & named[own[start]]]
        change = np.zeros(len(own) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, text = [], memoryview(words.bytes)[words.first :] if len(own) else b""
        for r in range(batch.num_rows):
            at = np.arange(words.bound[r], words.bound[r + 1])
            at = at[~gone[at]]
            kept.append(b" ".join(text[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)))
        removed = np.bincount(own[gone], minlength=batch.num_rows).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_text"])

    both = docs.join(firsts.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "firsts", "text")
    out = common.by_batch(both, each, "doc_id long, n_words long, n_removed long, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
