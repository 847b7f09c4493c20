"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids of a byte-level BPE vocabulary as the tokenizers library gives them: the string of an added token is that token.

    tiktoken gives the ids where both agree (the vocabulary is the same, and it is three times as fast); texts that it refuses
    and texts that hold an added token go to the tokenizers library.
    """

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.added = [token.content for token in self.slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(token in text for token in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except (ValueError, KeyError, RuntimeError):
            return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, cut from its end into whole sequences."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(vocabulary), []
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = np.array(encode(text or "") + [end_id], "<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
            rows += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        of, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else [()] * 6
        out = {"doc_id": batch.column(0).take(pa.array(of, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        out |= {"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return common.by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as it is there, whose sum is the largest that fits the room.

    Bit i of a row of the table is set if some choice of the lengths so far adds up to i; longer lengths are tried first.
    """
    reach, rows = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            rows.append((length, take, reach))
            reach |= reach << (length * take) & whole
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(rows):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, bins, first bin, offset): the i-th of these pieces goes to bin first + i, at the offset.

    Minimum bin slack: a bin takes the longest piece left, then the fullest feasible combination for the rest. The same
    combination is taken for as many bins as its lengths last, so the work depends on the capacity, not on the pieces.
    """
    left, used, slots, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(left.values()):
        longest = max(k for k, n in left.items() if n)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        need = {k: chosen.count(k) for k in chosen}
        times, offset = min(left[k] // n for k, n in need.items()), 0
        for k in chosen:
            slots.append((k, used[k], times, bins, offset))
            used[k] += times
            left[k] -= times
            offset += k
        bins += times
    return slots


def pack(cut: DataFrame, capacity: int = 1024, group_rows: int = 250) -> DataFrame:
    """The rows of `cut` (saved pieces, of 1 to capacity tokens) with sequence_id and offset.

    Only the number of pieces of each length matters for the plan: at most `capacity` counts reach the driver. Pieces of one
    length are numbered in parts of about group_rows rows (more, if there are over 200,000 parts), which a prefix sum over
    the parts' sizes makes one numbering; so a length that a third of all pieces share takes many tasks.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = plan(counts, capacity)
    by_length = {k: sorted(s[1:] for s in slots if s[0] == k) for k in counts}
    table = spark.sparkContext.broadcast({k: tuple(np.array(column) for column in zip(*v, strict=True)) for k, v in by_length.items()})
    parts = max(1, max(counts.values(), default=1) // max(group_rows, sum(counts.values()) // 200_000))
    rows = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = rows.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("own", "before", "part")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            own, (first, _, bins, place) = length == k, table.value[int(k)]
            slot = np.searchsorted(first, rank[own], "right") - 1
            sequence[own], offset[own] = bins[slot] + rank[own] - first[slot], place[slot]
        keep = [c for c in batch.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    names = [f.name for f in ranked.schema if f.name != "rank"]
    schema = ", ".join([f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names] + ["sequence_id long", "offset long"])
    return common.by_batch(ranked, each, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null and empty texts are one piece of the end id. Rows with a null or repeated id are packed like any other. Texts are
    tokenised once; the pieces are written to the shared folder before they are numbered.
    """
    cut = common.saved(pieces(docs, id_col, text_col, capacity, end_id, vocabulary, with_ids), "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return pack(cut, capacity).select(*order)
