"""What an answer leaves out: numbers and lists of factors that its evidence states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fuse import first_of

#: What questions about resources ask for, what sentences about resources say, and what counts as a number there.
RESOURCE_ASKED = ["efficiency", "efficient", "resource", "memory", "parameter", "parameters", "compute", "storage", "throughput", "latency", "speedup", "faster", "smaller", "cost"]
RESOURCE_TERMS = ["trainable parameter", "trainable parameters", "memory requirement", "memory", "storage", "compute", "throughput", "latency", "speedup", "faster", "smaller", "efficient", "efficiency"]
NUMBER = r"\b(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?\s*(?:x|times|%|m|b|k|million|billion))\b"
#: What questions about factors are about and ask, and the factors that sentences name.
FACTOR_TOPICS = ["design", "training", "factor", "factors", "ablation", "component", "components"]
FACTOR_ASKS = ["important", "identify", "affect", "effect", "learned representation", "representation"]
FACTORS = ["data augmentation", "augmentations", "composition", "critical", "important", "learnable", "nonlinear", "transformation", "loss", "batch", "batch size", "training steps", "temperature", "component", "components"]
FACTORS_NAMED, FACTORS_MISSING, SENTENCE = 4, 2, 420
REFUSALS = ["不能证明", "无法证明", "证据不足", "没有证据", "没有找到", "不能可靠回答", "无法回答", "cannot answer", "no evidence", "not enough evidence", "unable to answer"]


def plain(text: Column) -> Column:
    """Lower case, one kind of dash and comma, white space as single spaces."""
    return T.squeeze(F.translate(F.lower(T.whole(text)), "‑–—，", "---,"))


def fact_sentences(evidence: DataFrame) -> DataFrame:
    """evidence (qid, citation_id, score, pos, quote, text) as sentences (qid, citation_id, score, pos, sentence), long ones cut at a word."""
    whole = T.squeeze(F.concat_ws(" ", F.nullif("quote", F.lit("")), F.nullif("text", F.lit(""))))
    parts = F.filter(F.split(whole, r"(?<=[.!?;])\s+|\s+[•-]\s+"), lambda p: F.length(F.trim(p)) > 0)
    rows = evidence.select("qid", "citation_id", F.coalesce("score", F.lit(0.0)).alias("score"), "pos", F.explode(F.transform(parts, lambda p: F.btrim(p, F.lit(" -;")))).alias("sentence"))
    space = F.length(F.substring_index(F.substring("sentence", 1, SENTENCE), " ", -1))
    at = F.when(SENTENCE - space - 1 < int(SENTENCE * 0.6), SENTENCE).otherwise(SENTENCE - space - 1)
    cut = F.concat(F.rtrim(F.substr("sentence", F.lit(1), at), F.lit(" ,;")), F.lit("..."))
    return rows.withColumn("sentence", F.when(F.length("sentence") <= SENTENCE, F.col("sentence")).otherwise(cut))


def omitted(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, kind, citation_id, sentence, missing): for questions about resources (`number`) and about factors (`factor`) the evidence
    sentence that states most of what the answer doesn't say.

    answers: qid, question, answer. A sentence counts if it names a resource and holds numbers with a unit or thousands mark of which one
    isn't in the answer, or names four factors of which two aren't. The best has most missing, then most terms, then the higher score
    and length; ties go to the evidence that comes first. Evidence without a citation, and answers that refuse, are left out.
    """
    asked = answers.select("qid", plain(F.col("question")).alias("asked"), plain(F.col("answer")).alias("said"))
    about_numbers = F.col("asked").rlike(r"\b(?:" + "|".join(RESOURCE_ASKED) + r")\b")
    about_factors = T.contains_any(F.col("asked"), FACTOR_TOPICS) & T.contains_any(F.col("asked"), FACTOR_ASKS)
    asked = asked.where(~T.contains_any(F.col("said"), REFUSALS)).select("qid", "said", about_numbers.alias("number"), about_factors.alias("factor")).where("number or factor")
    rows = fact_sentences(evidence.where("citation_id is not null")).join(asked, "qid").withColumn("low", plain(F.col("sentence")))
    named = lambda terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("low"), t))
    absent = lambda found: F.array_distinct(F.filter(found, lambda x: ~F.contains(F.col("said"), plain(x))))
    resources, factors, numbers = named(RESOURCE_TERMS), named(FACTORS), F.regexp_extract_all("low", F.lit(NUMBER), 0)
    number = F.when(F.col("number") & (F.size(resources) > 0) & (F.size(absent(numbers)) > 0), F.struct(F.lit("number").alias("kind"), absent(numbers).alias("missing"), F.size(resources).alias("terms")))
    factor = F.when(F.col("factor") & (F.size(factors) >= FACTORS_NAMED) & (F.size(absent(factors)) >= FACTORS_MISSING), F.struct(F.lit("factor").alias("kind"), absent(factors).alias("missing"), F.size(factors).alias("terms")))
    found = rows.select("qid", "citation_id", "score", "pos", "sentence", F.explode(F.array_compact(F.array(number, factor))).alias("f")).select("*", "f.*").drop("f")
    order = [-F.size("missing"), -F.col("terms"), -F.col("score"), -F.length("sentence"), F.col("pos")]
    found = found.withColumns({f"_{i}": c for i, c in enumerate(order)})
    return first_of(found, ["qid", "kind"], *[f"_{i}" for i in range(len(order))]).select("qid", "kind", "citation_id", "sentence", "missing")


def completed(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers (qid, answer, ...) with each omitted sentence after the answer, under its citation; numbers come before factors."""
    cited = F.concat(F.lit("["), "citation_id", F.lit("]"))
    shown = F.when(F.contains("sentence", cited), F.col("sentence")).otherwise(F.concat_ws(" ", "sentence", cited))
    lines = facts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") == "factor").alias("after"), F.concat(F.lit("\n\n关键事实补充："), shown).alias("line")))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return answers.join(lines, "qid", "left").withColumn("answer", F.when(F.col("lines").isNull(), F.col("answer")).otherwise(F.concat(F.rtrim(T.whole(F.col("answer"))), joined))).drop("lines")
