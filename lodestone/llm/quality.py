"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted good texts are the positives; texts without a label are the unlabelled sample, a mixture in which the positives' share
(the class prior) is estimated. With l the logistic loss, the risk is prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, learning
from .common import Words, sequence_hash
from .learning import sigmoid

#: Rows of each kind, trusted and unlabelled, that the fit takes at most (chosen by a hash of the id). At this size chance alone
#: moves the estimated class prior by up to 0.02 (twice the standard error of a share of 10,000 rows, over both kinds).
FIT_ROWS = 10_000
#: Buckets that words and pairs of words are hashed into.
BUCKETS = 256
#: Weight of a standardised bucket beside a standardised number of the shape: there are many more buckets.
BUCKET_WEIGHT = 0.05
_KINDS = [b".,;:", b"!?", b"\"'()-", b"|%&$#*@^~=+<>{}[]\\/_", b"0123456789", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _CLASS[list(_bytes)] = _k


def _per_text(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bound[1:]] - total[bound[:-1]]).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """Of each text its shape (lengths, shares of kinds of bytes, how much its words repeat) and its hashed words and pairs of words."""
    words = Words(texts, 1)
    n, size = np.diff(words.bound).astype(float), np.diff(words.offsets).astype(float)
    arr = np.frombuffer(words.bytes, np.uint8)[words.first : words.first + words.offsets[-1]] if words.offsets[-1] else np.zeros(0, np.uint8)
    kind = _CLASS[arr]
    shares = [_per_text(kind == k, words.offsets) / np.maximum(size, 1) for k in range(len(_KINDS))]
    high = _per_text(arr > 127, words.offsets) / np.maximum(size, 1)
    h, row = words.hash, words.rows()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    long_ = words.end - words.start
    marks = np.concatenate([[0], np.cumsum((kind != len(_KINDS)) & (kind != 5))])
    odd = (marks[words.end] - marks[words.start]) * 2 >= long_  # words that are mostly marks, digits or capitals
    per = np.maximum(n, 1)
    ends = kind[words.end - 1] < 4 if len(h) else np.zeros(0, bool)
    shape = [np.log1p(n), np.log1p(size), size / per / 10, high, *shares, _per_text(again, words.bound) / per, _per_text(new, words.bound) / per, _per_text(odd, words.bound) / per, _per_text(ends, words.bound) / per, np.sqrt(_per_text(new, words.bound)) / per]
    # the words and pairs themselves: the root of each bucket's share
    pair = sequence_hash(h, 2, 5)
    same = row[:-1] == row[1:]
    cell = np.concatenate([row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), row[:-1][same] * BUCKETS + (pair[same] % np.uint64(BUCKETS)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
    bag = np.sqrt(np.bincount(cell, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS) / per[:, None])
    return np.column_stack([*shape, bag]).astype(np.float32)


class Net:
    """A small network (one hidden layer) on standardised features, trained on the non-negative risk with Adam."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 30, batch: int = 512, seed: int = 7):
        rng = np.random.default_rng(seed)
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._z(positive), self._z(unlabelled)
        d = p.shape[1]
        w = [x.astype(np.float32) for x in (rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1))]
        m, s, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        for _ in range(epochs):
            pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
            steps = max(1, max(len(p), len(u)) // batch)
            for pb, ub in zip(np.array_split(pi, steps), np.array_split(ui, steps), strict=True):
                if not len(pb) or not len(ub):
                    continue
                x = np.vstack([p[pb], u[ub]])
                a = np.maximum(x @ w[0] + w[1], 0)
                f = np.clip(a @ w[2] + w[3][0], -30, 30)
                fp, fu = f[: len(pb)], f[len(pb) :]
                rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()  # risk of the negatives
                if rest >= 0:
                    g = np.concatenate([prior * (sigmoid(fp) - 1 - sigmoid(fp)) / len(pb), sigmoid(fu) / len(ub)])
                else:  # it can't be negative: step back
                    g = np.concatenate([prior * sigmoid(fp) / len(pb), -sigmoid(fu) / len(ub)])
                back = np.outer(g, w[2]) * (a > 0)
                grads, t = [x.T @ back + 1e-4 * w[0], back.sum(axis=0), a.T @ g + 1e-4 * w[2], np.array([g.sum()])], t + 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        if z.shape[1] > BUCKETS:
            z[:, -BUCKETS:] *= BUCKET_WEIGHT
        return z

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return sigmoid(np.maximum(self._z(x) @ w[0] + w[1], 0) @ w[2] + w[3][0])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled: the least ratio, over top parts of a ranking, of the unlabelled rows in
    the part to the positives in it, with a margin for chance (best-bin estimate)."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1, 400)))
    p = (len(positive) - np.searchsorted(np.sort(positive), cuts)) / len(positive)
    u = (len(unlabelled) - np.searchsorted(np.sort(unlabelled), cuts)) / len(unlabelled)
    margin = np.sqrt(np.log(4 / confidence) / 2 / len(positive)) + np.sqrt(np.log(4 / confidence) / 2 / len(unlabelled))
    p, u = p[p > 0], u[p > 0]
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class Model:
    """The network, or a constant where there are no positives or no unlabelled texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_out: int = 1):
        labels = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
        known = common.small_side(labels, labels.count())
        rows = docs.where("doc_id is not null").join(known, "doc_id", "left").withColumn("fold", learning.fold("doc_id", folds))
        rows = rows.where(F.col("y").isNull() | (F.col("y") == 1) & (F.col("fold") != held_out)).select("doc_id", "text", F.coalesce("y", F.lit(0)).alias("y"))
        n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        self.net, self.prior = None, 1.0 if n.get(1) else 0.0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0))), pa.list_(pa.float32())), batch.column(1)], ["x", "y"])

        if not (n.get(0) and n.get(1)):
            return
        some = learning.sample(rows.where("y = 1"), n[1], FIT_ROWS).union(learning.sample(rows.where("y = 0"), n[0], FIT_ROWS))
        got = common.by_batch(some.select("text", "y"), each, "x array<float>, y int").toArrow()
        x, y = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1).astype(np.float32), got["y"].to_numpy()
        order = np.lexsort((*x[:, :16].T, y))
        x, y = x[order], y[order]
        half = np.random.default_rng(3).random(len(y)) < 0.5
        parts = [x[h & (y == k)] for h in (half, ~half) for k in (1, 0)]
        self.prior = 0.5
        if all(map(len, parts)):
            first = Net(parts[0], parts[1], 0.5, epochs=10)  # ranks positives against unlabelled
            self.prior = class_prior(first(parts[2]), first(parts[3]))
        self.net = Net(x[y == 1], x[y == 0], self.prior)

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.net(features(texts)) if self.net is not None else np.full(len(texts), self.prior)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher is better).

    Positives are rows labelled 1 outside the held-out fold, the unlabelled sample are rows without any label; labels of 0 are
    never used. Null texts count as empty, and an empty text is scored like any other. Rows with a null id are scored and never
    learnt from; rows that repeat an id are learnt from each. Very long texts are read whole. Without unlabelled texts every score
    is 1, without positives 0.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(Model(docs, labels, "quality", folds, held_out))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(model.value.score(batch.column(1)), float))], ["doc_id", "score"])

    return common.by_batch(docs, each, "doc_id long, score double")
