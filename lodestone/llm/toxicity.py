"""Toxicity by class-conditional Kneser-Ney word models.

There is a model of toxic and one of ordinary texts, each with its own counts, discounts and context sums. P(w | v, class) is
the class's discounted count of w after v, plus backoff mass, over the class's sum for the context v; an expression that
neither class has after v backs off to P(w | class), from the numbers of words that w follows, and a word that neither has to
its stem (its first bytes), where all words of a stem share their counts. Backoff mass is worth the same number of
occurrences in both classes and split between them as the next shorter expression is: what is rare in either class says little
more than what it shares with other words.

A text's evidence is its log-likelihood under one model less that under the other, of the expressions for which this exceeds
MARGIN nats, per word of the text, so that long ordinary passages don't hide others. One logistic curve, fitted on labelled rows
that its counts don't hold, makes that a score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, learning
from .common import Words, mix

STEM_BYTES = 5
#: Log-likelihood ratio of one expression that counts as none, and the most that counts.
MARGIN, MOST = 1.0, 8.0
#: Occurrences that the backoff mass of a word and of a pair of words is worth.
WORD_BACKOFF, PAIR_BACKOFF = 10.0, 300.0
#: Entries of a model that one pass over the texts holds; a larger model takes several passes, and no entry is left out.
PASS_ENTRIES = 4_000_000
#: Labelled rows that the logistic fit takes at most.
FIT_ROWS = 50_000
_MARKS = ".,;:!?\"()[]{}<>|*#%&$_~`^=+"


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the text in lower case without punctuation marks."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), prepared_text(text_col).alias("text"))


def prepared_text(text_col: str) -> Column:
    return F.translate(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _MARKS, "").cast("binary")


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _keys(words: Words) -> np.ndarray:
    """Of each word a key of 64 bits, whose upper half is that of its stem."""
    half = np.uint64(32)
    return (words.stem >> half << half) | (words.hash >> half)


def _before(words: Words, keys: np.ndarray) -> np.ndarray:
    """Of each word the key of the one before it in its text, 0 for the first."""
    v = np.concatenate([[np.uint64(0)], keys[:-1]]) if len(keys) else keys.copy()
    v[words.bound[:-1][np.diff(words.bound) > 0]] = 0
    return v


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(v, w, t, o, t1, o1): of each word w after v, the occurrences in toxic and in ordinary texts; t1 and o1 in those with
    `inner` only. rows: text, y, inner (0 or 1). Each batch is added up and sorted before Spark adds up and shuffles."""
    names = ["t", "o", "t1", "o1"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(batch.column(0), STEM_BYTES)
        if not len(words.hash):
            return None
        w, toxic, inner = _keys(words), *(batch.column(k).to_numpy()[words.rows()] == 1 for k in (1, 2))
        v = _before(words, w)
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        sums = [pa.array(np.add.reduceat(x[order].astype(np.int64), first)) for x in (toxic, ~toxic, toxic & inner, ~toxic & inner)]
        return pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), *sums], ["v", "w", *names])

    found = common.by_batch(rows.select("text", "y", "inner"), each, "v long, w long, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("v", "w").agg(*[F.sum(n).alias(n) for n in names])


def _discounts(df: DataFrame) -> dict[str, float]:
    """Of each class (columns t and o): Kneser-Ney's discount n1 / (n1 + 2 n2), and the sum of its counts."""
    out = df.agg(*[f.alias(f"{c}{n}") for c in ("t", "o") for n, f in (("1", F.count_if(F.col(c) == 1)), ("2", F.count_if(F.col(c) == 2)), ("_sum", F.sum(c)))]).head()
    return {c: out[f"{c}1"] / max(1, out[f"{c}1"] + 2 * out[f"{c}2"]) for c in ("t", "o")} | {f"{c}_sum": float(out[f"{c}_sum"] or 0) or 0.5 for c in ("t", "o")}


def evidence(counts: DataFrame) -> DataFrame:
    """(level, key, w, g): of each pair (level 2, with v), word (1) and stem (0) what it adds to a text's evidence.

    counts: (v, w, t, o). Entries that add what their backoff adds anyway aren't kept, so results don't change by that, and what
    is kept are the expressions around those that mark one class.
    """
    prior, odds = lambda of: F.lit(of["t_sum"] / of["o_sum"]), lambda x: x / (1 + x)
    gain = lambda x: F.greatest(F.least(x, F.lit(MOST)) - MARGIN, F.lit(0.0)).cast("float")
    beside = lambda df: common.small_side(df, df.count())

    mass = lambda c, q, discount, backoff: F.greatest(F.col(c) - discount[c], F.lit(0.0)) + backoff * q

    # words by the number of words that they follow; one of a single pair is known from that pair's row
    words = common.saved(counts.groupBy("w").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"), F.count("*").alias("n")), "words")
    d, stem = _discounts(words), F.shiftrightunsigned("w", 32)
    share = d["t_sum"] / (d["t_sum"] + d["o_sum"])
    stems = words.groupBy(stem.alias("s")).agg(((F.sum("t") + WORD_BACKOFF * share) / (F.sum(F.col("t") + F.col("o")) + WORD_BACKOFF)).alias("back"))
    stems = common.saved(stems.withColumn("g0", gain(F.log(F.col("back") / (1 - F.col("back")) / prior(d)))), "stems")
    ratio = mass("wt", F.col("back"), {"wt": d["t"]}, WORD_BACKOFF) / mass("wo", 1 - F.col("back"), {"wo": d["o"]}, WORD_BACKOFF) / prior(d)
    by_stem = lambda df: df.join(beside(stems), stem == F.col("s"))
    rated = by_stem(words.select("w", F.col("t").alias("wt"), F.col("o").alias("wo"))).withColumn("g1", gain(F.log(ratio)))

    # pairs, and contexts by the sums of what follows them; one with a single follower is known from its row
    e = _discounts(counts)
    often = words.where("n > 1").select("w", F.col("t").alias("often_t"), F.col("o").alias("often_o"))
    pairs = by_stem(counts.join(beside(often), "w", "left").withColumns({f"w{c}": F.coalesce(f"often_{c}", (F.col(c) > 0).cast("long")) for c in ("t", "o")}))
    q = odds(ratio * prior(e))
    pairs = pairs.select("v", "w", gain(F.log(ratio)).alias("g1"), mass("t", q, e, PAIR_BACKOFF).alias("t"), mass("o", 1 - q, e, PAIR_BACKOFF).alias("o"))
    context = lambda t, o: (t + PAIR_BACKOFF * e["t_sum"] / (e["t_sum"] + e["o_sum"])) / (o + PAIR_BACKOFF * e["o_sum"] / (e["t_sum"] + e["o_sum"]))
    contexts = pairs.groupBy("v").agg(context(F.sum("t"), F.sum("o")).alias("context"), F.count("*").alias("n")).where("n > 1").drop("n")
    contexts = common.saved(contexts, "contexts")
    g = gain(F.log(F.col("t") / F.col("o") / F.coalesce("context", context(F.col("t"), F.col("o")))))
    found = pairs.join(beside(contexts), "v", "left").withColumn("g", g).where("g <> g1").select(F.lit(2).alias("level"), "v", "w", "g")
    none = F.lit(0).cast("long")
    found = found.union(rated.where("g1 <> g0").select(F.lit(1), none, "w", "g1"))
    return found.union(stems.where("g0 > 0").select(F.lit(0), none, "s", "g0"))


class Table:
    """A value by 64-bit key, else the value given."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def __call__(self, key: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return otherwise
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], otherwise)


class Part:
    """Of `parts` parts of a model, the one for words whose stem falls into it."""

    def __init__(self, entries: pa.Table, part: int, parts: int):
        self.part, self.parts = np.uint64(part), np.uint64(parts)
        level, v, w, g = (entries[c].to_numpy() for c in ("level", "v", "w", "g"))
        v, w = v.view(np.uint64), w.view(np.uint64)
        self.pairs, self.words, self.stems = (Table(_pair(v[level == k], w[level == k]) if k == 2 else w[level == k], g[level == k]) for k in (2, 1, 0))

    def evidence(self, words: Words) -> np.ndarray:
        """Of each word what it adds, 0 for words of other parts."""
        keys = _keys(words)
        stem = keys >> np.uint64(32)
        g = self.words(keys, self.stems(stem, np.zeros(len(keys), np.float32)))
        return np.where(stem % self.parts == self.part, self.pairs(_pair(_before(words, keys), keys), g), 0)

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the evidence of this part, and its words."""
        words = Words(texts, STEM_BYTES)
        return np.bincount(words.rows(), self.evidence(words), len(texts)), np.diff(words.bound)


class KneserNey:
    """Both models' comparison, from saved counts (v, w, t, o), in parts that one pass over the texts can hold."""

    def __init__(self, counts: DataFrame):
        entries = common.saved(evidence(counts), "model")
        self.parts = max(1, -(-entries.count() // PASS_ENTRIES))
        stem = F.when(F.col("level") == 0, F.col("w")).otherwise(F.shiftrightunsigned("w", 32))
        self.entries = entries.withColumn("part", stem % self.parts)

    def part(self, k: int) -> Part:
        return Part(self.entries.where(F.col("part") == k).drop("part").toArrow(), k, self.parts)


class Model:
    """The models and the curve that makes their comparison a score; a constant where labels of one class are missing."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2):
        rows = learning.labelled(prepared(docs, id_col, text_col).where("doc_id is not null"), labels, label_col, id_col).withColumn("fold", learning.fold("doc_id", folds))
        fit_fold = (held_out + 1) % folds
        seen = {(r["fold"], r["y"]): r["n"] for r in rows.drop("text").where(F.col("fold") != held_out).groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
        of = lambda y, fit: sum(n for (f, x), n in seen.items() if x == y and (fit is None or (f == fit_fold) == fit))
        self.model = self.fit = None
        self.constant = of(1, None) / max(1, sum(seen.values()))
        if not (of(0, None) and of(1, None)):
            return
        permitted = rows.where(F.col("fold") != held_out).withColumn("inner", (F.col("fold") != fit_fold).cast("int"))
        counts = common.saved(ngram_counts(permitted).sortWithinPartitions("v"), "ngrams")  # sorted, the table takes less room
        if of(0, False) and of(1, False) and of(0, True) and of(1, True):
            inner = KneserNey(counts.where("t1 + o1 > 0").select("v", "w", F.col("t1").alias("t"), F.col("o1").alias("o")))
            fit_rows = learning.sample(rows.where(F.col("fold") == fit_fold), of(0, True) + of(1, True), FIT_ROWS).select(F.col("y").alias("key"), "text")
            got = densities(fit_rows, inner).toArrow()
            self.fit = learning.Logistic(got["x"].to_numpy()[:, None], got["key"].to_numpy())
        # what scores is counted over all permitted folds
        self.model = KneserNey(counts.select("v", "w", "t", "o"))

    def curve(self, x: Column) -> Column:
        """The score of a density, on the logistic curve."""
        slope, middle, start = (self.fit.w[1] / self.fit.scale[0], self.fit.mean[0], self.fit.w[0]) if self.fit is not None else (10.0, 0.2, 0.0)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), float(start) + float(slope) * (x - float(middle))))))


def densities(rows: DataFrame, model: KneserNey) -> DataFrame:
    """rows (key, text) as (key, x), with the density of each one's evidence. One pass over the texts for each part of the model."""

    def passed(rows: DataFrame, k: int) -> DataFrame:
        part = rows.sparkSession.sparkContext.broadcast(model.part(k))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, words = part.value.totals(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(words)], ["key", "total", "words"])

        return common.by_batch(rows, each, f"key {rows.schema['key'].dataType.simpleString()}, total double, words long")

    if model.parts == 1:
        out = passed(rows.select("key", "text"), 0)
    else:
        rows = common.saved(rows.withColumn("place", F.monotonically_increasing_id()), "numbered")
        every = reduce(DataFrame.union, [passed(rows.select(F.col("place").alias("key"), "text"), k) for k in range(model.parts)])
        every = every.groupBy(F.col("key").alias("place")).agg(F.sum("total").alias("total"), F.first("words").alias("words"))
        out = rows.select("key", "place").join(every, "place")
    return out.select("key", F.sqrt(F.round(F.col("total") / F.greatest("words", F.lit(1)), 9)).alias("x"))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(key, score) of rows (key, text)."""
    if model.model is None:
        return rows.select("key", F.lit(model.constant).cast("double").alias("score"))
    return densities(rows, model.model).select("key", model.curve(F.col("x")).alias("score"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1). Labels are learnt from rows whose id isn't in the held-out fold; a score
    looks at the text alone.

    Null texts count as empty; empty texts get the score of no evidence. Rows with a null id are scored and never learnt from;
    rows that repeat an id are scored each and learnt from each. Very long texts are read whole. Without labels of both classes
    every score is the share of toxic labels (0 without labels).
    """
    model = Model(docs, labels, "toxic", id_col, text_col, folds, held_out)
    return scored(prepared(docs, id_col, text_col).withColumnRenamed("doc_id", "key"), model).withColumnRenamed("key", "doc_id")


def keep_below(docs: DataFrame, labels: DataFrame, limit: float, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the limit; a model of one part scores them where they are."""
    model = Model(docs, labels, "toxic", id_col, text_col, folds, held_out)
    out = scored(docs.select(F.struct("*").alias("key"), prepared_text(text_col).alias("text")), model)
    return out.where(F.col("score") < limit).select("key.*")
