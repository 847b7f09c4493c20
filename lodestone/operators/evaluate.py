"""Scores of runs against gold evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def gold_hits(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, gold_no, doc_id, rank): evidence (qid, doc_id, page_start, page_end, rank, text) that answers gold (qid, gold_no,
    documents, page, phrases): of one of the documents (any if none is named), on the page (any if null), with all phrases,
    each of which may list alternatives with |. An equi-join on the question; the rest is checked on its pairs."""
    pairs = gold.join(evidence.withColumn("form", T.evaluation_form(F.col("text"))), "qid")
    named = (F.size(F.coalesce("documents", F.array().cast("array<string>"))) == 0) | F.array_contains("documents", F.col("doc_id").cast("string"))
    paged = F.col("page").isNull() | F.col("page").between(F.col("page_start"), F.col("page_end"))
    return pairs.where(named & paged & (T.term_rate(F.col("phrases"), F.col("form")) == 1.0)).select("qid", "gold_no", "doc_id", "rank").distinct()


def recall(gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(qid, n_gold, recall): the share of a question's gold that is among the first k."""
    met = hits.where(F.col("rank") <= k).select("qid", "gold_no").distinct().withColumn("met", F.lit(1))
    return gold.join(met, ["qid", "gold_no"], "left").groupBy("qid").agg(F.count("*").alias("n_gold"), (F.count("met") / F.count("*")).alias("recall"))


def support_rate(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, support): the share of cited evidence (qid, doc_id, rank) that answers some gold; 0 for a question that cites nothing."""
    good = hits.select("qid", "doc_id", "rank").distinct().withColumn("good", F.lit(1))
    return evidence.join(good, ["qid", "doc_id", "rank"], "left").groupBy("qid").agg((F.count("good") / F.count("*")).alias("support"))


def document_coverage(expected: Column, found: Column, required: Column) -> Column:
    """Expected documents found, or distinct documents found over those required; 1 if nothing is asked for."""
    named = F.size(F.array_intersect(expected, found)) / F.size(expected)
    return F.when(F.size(expected) > 0, named).when(required > 0, F.least(F.lit(1.0), F.size(F.array_distinct(found)) / required)).otherwise(1.0)


#: Checks of smoke cases, in order, with the category that a failure counts under.
SMOKE = {"answer_completed": "answer_generation_failure", "evidence_present": "no_evidence", "citation_linked": "citation_missing", "document_match": "wrong_document", "evidence_keywords": "evidence_keyword_missing", "answer_keywords": "answer_keyword_missing", "refusal_when_expected": "refusal_missing", "embedding_not_fallback": "embedding_fallback"}


def smoke(rows: DataFrame) -> DataFrame:
    """Scores cases: answer, n_evidence, n_valid_citations, document_coverage, evidence_keyword_rate, answer_keyword_rate,
    expected_refusal, refusal, used_fallback (rates are 1 where no keywords are asked for)."""
    tests = {
        "answer_completed": F.length(F.trim(T.whole(F.col("answer")))) > 0, "evidence_present": F.col("n_evidence") > 0, "citation_linked": F.col("n_valid_citations") > 0,
        "document_match": F.col("document_coverage") >= 1, "evidence_keywords": F.col("evidence_keyword_rate") > 0, "answer_keywords": F.col("answer_keyword_rate") > 0,
        "refusal_when_expected": ~F.col("expected_refusal") | F.col("refusal"), "embedding_not_fallback": ~F.col("used_fallback"),
    }
    failures = F.array_compact(F.array(*[F.when(~F.coalesce(tests[name], F.lit(False)), F.lit(category)) for name, category in SMOKE.items()]))
    out = rows.withColumn("failures", failures)
    return out.withColumn("score", 1 - F.size("failures") / len(SMOKE)).withColumn("status", F.when(F.size("failures") == 0, "pass").otherwise("fail"))


#: Checks of gold cases, in order, with the category that a failure counts under.
GOLD = {"answer_completed": "answer_generation_failure", "evidence_present": "no_evidence", "citation_linked": "citation_missing", "document_match": "wrong_document", "retrieval_recall_at_k": "gold_evidence_missed", "citation_support_rate": "citation_unsupported", "answer_point_coverage": "answer_point_missing", "refusal_accuracy": "refusal_missing", "embedding_not_fallback": "embedding_fallback"}


def refuses(answer: Column) -> Column:
    """Whether an answer says that the evidence isn't enough."""
    return T.contains_any(T.evaluation_form(answer), fixed.REFUSAL_SIGNALS)


def expects_refusal(question: Column, given: Column) -> Column:
    """What the case says, or else what its question sounds like."""
    return F.coalesce(given, T.contains_any(T.evaluation_form(question), fixed.REFUSAL_EXPECTED))


def is_gold(n_gold: Column, n_points: Column, case_type: Column, difficulty: Column) -> Column:
    """Which scoring a case gets: that against gold, or the smoke checks."""
    return (F.coalesce(n_gold, F.lit(0)) > 0) | (F.coalesce(n_points, F.lit(0)) > 0) | (F.length(T.whole(case_type)) > 0) | (F.length(T.whole(difficulty)) > 0)


def gold_cases(rows: DataFrame) -> DataFrame:
    """Adds failures, score and status to cases: answer (null: it failed, status blocked, score 0), n_evidence,
    n_valid_citations, document_coverage, recall and support (null where no gold is asked for), point_coverage (null without
    points), expected_refusal, used_fallback. Half of the gold and of the citations and .67 of the points are enough."""
    enough = lambda name, least: F.coalesce(F.col(name) >= least, F.lit(True))
    tests = {
        "answer_completed": F.length(T.strip(T.whole(F.col("answer")))) > 0, "evidence_present": F.col("n_evidence") > 0, "citation_linked": F.col("n_valid_citations") > 0,
        "document_match": enough("document_coverage", 1.0), "retrieval_recall_at_k": enough("recall", 0.5), "citation_support_rate": enough("support", 0.5),
        "answer_point_coverage": enough("point_coverage", 0.67), "refusal_accuracy": ~F.col("expected_refusal") | refuses(F.col("answer")), "embedding_not_fallback": ~F.col("used_fallback"),
    }
    blocked = F.col("answer").isNull()
    failures = F.array_compact(F.array(*[F.when(~F.coalesce(tests[name], F.lit(False)), F.lit(category)) for name, category in GOLD.items()]))
    out = rows.withColumn("failures", F.when(blocked, F.array(F.lit(GOLD["answer_completed"]))).otherwise(failures))
    score = F.when(blocked, 0.0).otherwise(1 - F.size("failures") / len(GOLD))
    return out.withColumn("score", score).withColumn("status", F.when(blocked, "blocked").when(F.size("failures") == 0, "pass").otherwise("fail"))


def roll_up(results: DataFrame, by: list[str], averages: list[str]) -> DataFrame:
    """A run's cases by `by`, with all sub-totals: how many passed, and averages."""
    return results.cube(*by).agg(F.count("*").alias("n_cases"), F.count_if(F.col("status") == "pass").alias("n_passed"), *[F.avg(a).alias(f"avg_{a}") for a in averages])


def failure_counts(results: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent failure categories, by count and then by name."""
    return results.select(F.explode("failures").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(most)


def stage_audit(gold: DataFrame, hits_by_stage: DataFrame, stages: list[str]) -> DataFrame:
    """(qid, gold_no, one flag per stage, first_stage, last_stage): where gold evidence is met; hits_by_stage: qid, gold_no, stage."""
    flags = hits_by_stage.groupBy("qid", "gold_no").agg(*[F.bool_or(F.col("stage") == s).alias(s) for s in stages])
    out = gold.select("qid", "gold_no").join(flags, ["qid", "gold_no"], "left").fillna(False, stages)
    return out.withColumn("first_stage", F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in stages])).withColumn("last_stage", F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in reversed(stages)]))
