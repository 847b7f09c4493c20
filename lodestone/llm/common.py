"""What several training-data operators share: checked broadcasts, word hashing, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import saved

#: Rows of a side that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose row count was checked against the limit; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def by_batch(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; batches are cut so that a task holds about 4 MB of input text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 4e6 / max(batch.nbytes, 1)))
            for k in range(0, batch.num_rows, step):
                if (out := each(batch.slice(k, step))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


# ------------------------------------------------------------------ words

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SEGMENT = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SEGMENT, base, np.uint64)]), dtype=np.uint64)


#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 2048
#: Start and factor of each of two hashes.
_LANES = tuple((np.uint64(a), np.uint64(b)) for a, b in ((0x243F6A8885A308D3, 0x9FB21C651E98DF25), (0x13198A2E03707344, 0xD6E8FEB86659FD93)))


def block_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte range of data: every eight bytes go through a multiplication and the scrambler
    together with what came before. Ranges of eight bytes or fewer never share a hash with others of their length."""
    size = end - start
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    lanes = [mix(size.astype(np.uint64) + seed) for seed, _ in _LANES]
    open_ = np.flatnonzero(size <= _LONG_WORD)
    with np.errstate(over="ignore"):
        for at in range(0, _LONG_WORD, 8):
            open_ = open_[size[open_] > at]
            if not len(open_):
                break
            block, left = blocks[start[open_] + at], np.minimum(size[open_] - at, 8).astype(np.uint64)
            block &= np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8))
            for lane, (_, factor) in zip(lanes, _LANES, strict=True):
                lane[open_] = mix((lane[open_] ^ block) * factor)
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        both = xxhash.xxh3_128_intdigest(data[start[k] : end[k]].tobytes())
        lanes[0][k], lanes[1][k] = both >> 64, both & (2**64 - 1)
    return lanes[0], lanes[1]


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of a batch of texts: per word its text's row, byte range and 64-bit hash.

    A hash is a polynomial over the word's bytes, read off running sums over all bytes of the batch, one segment at a time. With
    `exact`, where words must be told apart whatever they hold, `hash` and `second` are two keyed block hashes instead.
    """

    def __init__(self, texts: pa.Array, prefix: int = 0, exact: bool = False):
        if texts.null_count:
            texts = texts.fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.bytes = data if data is not None else pa.py_buffer(b"")
        arr = np.frombuffer(self.bytes, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        self.first = int(off[0])
        off = off - off[0]
        word = ~((arr == 32) | ((arr >= 9) & (arr <= 13)))
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        begin[heads] = word[heads]
        self.start = np.flatnonzero(begin)
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        tails = off[1:][off[:-1] < off[1:]] - 1
        stop[tails] = word[tails]
        self.end = np.flatnonzero(stop) + 1
        self.offsets = off
        self.bound = np.searchsorted(self.start, off)  # words of row r: bound[r] to bound[r + 1]
        self.hash, self.second = block_hashes(arr, self.start, self.end) if exact else (self._hash(arr, self.end), None)
        self.stem = self._hash(arr, np.minimum(self.end, self.start + prefix)) if prefix else None

    def _hash(self, arr: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(int(_BASE)), _powers(int(_INVERSE))
        head, tail = np.zeros(len(self.start), np.uint64), np.zeros(len(end), np.uint64)
        shift = np.zeros(len(self.start), np.uint64)
        total, scale, unscale = np.uint64(0), np.uint64(1), np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(0, len(arr), _SEGMENT):
                part = arr[k : k + _SEGMENT]
                run = np.empty(len(part) + 1, np.uint64)
                run[0] = total
                np.cumsum(_TABLE[part] * (up[: len(part)] * scale), out=run[1:])
                run[1:] += total
                a, b = np.searchsorted(self.start, (k, k + len(part)))
                head[a:b] = run[self.start[a:b] - k]
                shift[a:b] = down[self.start[a:b] - k] * unscale
                a, b = np.searchsorted(end, (k + 1, k + len(part) + 1))
                tail[a:b] = run[end[a:b] - k]
                total, scale, unscale = run[-1], scale * up[len(part)], unscale * down[len(part)]
            return mix((tail - head) * shift + (end - self.start).astype(np.uint64))

    def rows(self) -> np.ndarray:
        """Of each word its text's row."""
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))

    def index(self) -> np.ndarray:
        """Of each word its place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.bound[:-1], np.diff(self.bound))


def sequence_hash(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words, whichever text they are in; entry i is for words i to i + size - 1."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(int(mix(np.array([seed * 2 + 1], np.uint64))[0]) | 1)
    with np.errstate(over="ignore"):
        own = mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        out = own[:n].copy()
        for k in range(1, size):
            out *= factor
            out += own[k : k + n]
        return mix(out)


# ------------------------------------------------------------------ connected components


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b: long), by alternating large and small stars.

    Each round is two grouped minima with map-side combine and a join back that AQE may split for a hot node; a round's
    edges are written before the next begins. The driver sees two numbers per round.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = edges.agg(digest).head()[0]
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low)
        edges = saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        if (now := edges.agg(digest).head()[0]) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
