"""Labels and verdicts of evidence, checks of supplied answers, cards and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def quality_label(score: Column, relevance: Column, readability: Column, flags: Column) -> Column:
    """noise, strong, medium or weak; the first that holds."""
    return F.when(F.size(flags) > 0, "noise").when((score >= 0.72) | (relevance >= 0.24), "strong").when((score >= 0.45) | (relevance >= 0.1) | (readability >= 0.55), "medium").otherwise("weak")


def verdict(score: Column, relevance: Column, table_like: Column, allow_tables: Column) -> Column:
    """struct<verdict, confidence> of one piece of evidence for an ordinary question."""
    direct = (relevance >= 0.24) | (score >= 0.82)
    supporting = (relevance >= 0.08) | (score >= 0.45)
    reject = table_like & ~allow_tables
    name = F.when(reject, "reject").when(direct, "direct").when(supporting, "supporting").otherwise("background")
    sure = F.when(reject, 0.7).when(direct, F.least(F.lit(0.9), 0.58 + relevance)).when(supporting, 0.62).otherwise(0.45)
    return F.struct(name.alias("verdict"), F.bround(sure, 3).alias("confidence"))


def keep_judged(rows: DataFrame, strict: Column | None = None) -> DataFrame:
    """Direct and supporting evidence, background too unless the question is strict; renumbered by pos. Nothing is filled back."""
    background = F.col("verdict") == "background"
    kept = rows.where(F.col("verdict").isin("direct", "supporting") | (background & ~(F.lit(False) if strict is None else strict)))
    return kept.withColumn("citation_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("qid").orderBy("pos"))))


def question_quality(best_score: Column, best_relevance: Column, n: Column) -> Column:
    """A question's evidence by its best score and relevance."""
    return F.when(n == 0, "none").when((best_score >= 0.7) | (best_relevance >= 0.25), "strong").when((best_score >= 0.45) | (best_relevance >= 0.12), "medium").otherwise("weak")


def cited(answer: Column) -> Column:
    """Citation ids of an answer: those in brackets in their order, then bare ones."""
    found = F.concat(F.regexp_extract_all(answer, F.lit(r"\[E(\d+)\]"), 1), F.regexp_extract_all(answer, F.lit(r"(?<![A-Za-z0-9])E(\d+)(?![A-Za-z0-9])"), 1))
    return F.transform(F.array_distinct(found), lambda n: F.concat(F.lit("E"), n))


def cited_sentences(answers: DataFrame) -> DataFrame:
    """(qid, sentence_no, sentence, citation_id): each sentence with each citation that stands in it in brackets."""
    parts = F.filter(F.transform(F.split("answer", r"(?<=[。！？.!?])\s+|(?<=。)|(?<=！)|(?<=？)|\n+"), T.strip), lambda s: F.length(s) > 0)
    rows = answers.select("qid", F.posexplode(parts).alias("sentence_no", "sentence"))
    return rows.select("qid", "sentence_no", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"\[E(\d+)\]"), 1))).alias("n")).select("qid", "sentence_no", "sentence", F.concat(F.lit("E"), "n").alias("citation_id"))


def overlap_tokens(text: Column) -> Column:
    """Distinct tokens by which a sentence and its evidence are compared: CJK characters and words of three letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(T.sanitize(text)), F.lit(f"[{T.CJK}]|[a-z0-9]{{3,}}"), 0))


def overlap(sentence: Column, evidence: Column) -> Column:
    """The share of a sentence's tokens that its evidence has; 1 for a sentence without tokens."""
    own, other = overlap_tokens(F.regexp_replace(sentence, r"\[E\d+\]", "")), overlap_tokens(evidence)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def verify(answers: DataFrame, evidence: DataFrame, weak_below: float = 0.08) -> DataFrame:
    """(qid, n_cited, missing, n_weak, uncited, status) of answers (qid, answer) against evidence (qid, citation_id, text).

    fail: a citation that isn't there; warn: no citation, or a sentence that shares too little with what it cites. Answers that
    say evidence is missing needn't cite.
    """
    ids = answers.select("qid", "answer", cited(F.col("answer")).alias("ids"))
    asked = ids.select("qid", F.explode("ids").alias("citation_id"))
    there = evidence.select("qid", "citation_id").distinct()
    missing = asked.join(there, ["qid", "citation_id"], "left_anti").groupBy("qid").agg(F.array_sort(F.collect_list("citation_id")).alias("missing"))
    weak = cited_sentences(answers).join(evidence.select("qid", "citation_id", "text"), ["qid", "citation_id"]).where(overlap(F.col("sentence"), F.col("text")) < weak_below).groupBy("qid").agg(F.count("*").alias("n_weak"))
    held = evidence.groupBy("qid").agg(F.count("*").alias("n"))
    refusal = T.contains_any(F.col("answer"), ["没有找到", "证据不足", "不能可靠", "不应该硬编"])
    out = ids.join(missing, "qid", "left").join(weak, "qid", "left").join(held, "qid", "left")
    out = out.withColumns({"missing": F.coalesce("missing", T.empty()), "n_weak": F.coalesce("n_weak", F.lit(0)), "n_cited": F.size("ids"), "uncited": (F.coalesce("n", F.lit(0)) > 0) & (F.size("ids") == 0) & ~refusal})
    status = F.when(F.coalesce("n", F.lit(0)).eqNullSafe(0) & refusal, "pass").when(F.size("missing") > 0, "fail").when(F.col("uncited") | (F.col("n_weak") > 0), "warn").otherwise("pass")
    return out.select("qid", "n_cited", "missing", F.col("n_weak").cast("long").alias("n_weak"), "uncited", status.alias("status"))


def cards(scope: DataFrame, evidence: DataFrame) -> DataFrame:
    """A card for each question and document of the scope (qid, doc_id): how much evidence (qid, doc_id, pos, citation_id, page,
    chunk_type) there is, up to six citations, eight pages and five types. Documents without any keep an empty card."""
    listed = evidence.groupBy("qid", "doc_id").agg(
        F.count("*").alias("n_evidence"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "citation_id"))), lambda s: s["citation_id"]), 1, 6).alias("citations"),
        F.slice(F.array_sort(F.collect_set("page")), 1, 8).alias("pages"), F.slice(F.array_sort(F.collect_set("chunk_type")), 1, 5).alias("types"))
    out = scope.join(listed, ["qid", "doc_id"], "left")
    return out.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).withColumn("covered", F.col("n_evidence") > 0)


def coverage(cards_: DataFrame) -> DataFrame:
    """(qid, n_documents, n_covered, ratio, missing) over cards."""
    ratio = F.bround(F.count_if("covered") / F.count("*"), 3)
    return cards_.groupBy("qid").agg(F.count("*").alias("n_documents"), F.count_if("covered").alias("n_covered"), ratio.alias("ratio"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("doc_id")))).alias("missing"))


def relations(cards_: DataFrame, most: int = 12) -> DataFrame:
    """Pairs of a question's covered documents in their order (pos), with up to six shared terms; at most `most` pairs."""
    # the first pairs are those of the first documents: more than `most` + 1 of these are never needed
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    cards_ = cards_.withColumn("_nth", nth).where(F.col("_nth") <= most + 1).drop("_nth")
    left, right = cards_.alias("l"), cards_.alias("r")
    pairs = left.join(right, (F.col("l.qid") == F.col("r.qid")) & (F.col("l.pos") < F.col("r.pos")))
    shared = F.slice(F.array_intersect("l.terms", "r.terms"), 1, 6)
    kind = F.when(~F.col("l.covered") | ~F.col("r.covered"), "evidence_missing").when(F.size(shared) >= 2, "shared_topic").when(F.size(shared) == 1, "complementary").otherwise("parallel")
    out = pairs.select(F.col("l.qid").alias("qid"), F.col("l.doc_id").alias("source"), F.col("r.doc_id").alias("target"), F.col("l.pos").alias("p"), F.col("r.pos").alias("q"), shared.alias("shared_terms"), kind.alias("relation_type"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("p", "q"))).where(F.col("n") <= most).drop("n", "p", "q")


def coverage_gate(rows: DataFrame) -> DataFrame:
    """Adds `decision` (pass or refuse) and `reason_code`, the first that holds.

    Columns: n_evidence, local_task (a reference or field question), multi_document, n_requested, n_covered, visual, has_image, ocr, has_ocr_text, n_judged,
    n_supported (direct or supporting), broad, quality, all_weak (every label weak or noise), usable (weak labels that still
    support), best_relevance, misses_request.
    """
    c = F.col
    rules = [
        (c("local_task"), "deterministic_local_task", "pass"),
        (c("n_evidence") == 0, "no_evidence_after_judge", "refuse"),
        (c("multi_document") & (c("n_requested") > 1) & (c("n_covered") < c("n_requested")), "multi_document_coverage_incomplete", "refuse"),
        (c("visual") & ~c("has_image"), "missing_visual_evidence", "refuse"),
        (c("ocr") & ~c("has_ocr_text"), "missing_ocr_text", "refuse"),
        ((c("n_judged") > 0) & (c("n_supported") == 0) & ~c("broad"), "no_direct_supporting_judgment", "refuse"),
        (c("quality").isin("none", "weak"), None, "refuse"),
        (c("all_weak") & ~c("usable"), "all_final_evidence_weak_or_noise", "refuse"),
        (~c("broad") & (c("n_evidence") == 1) & (c("quality") != "strong") & (c("best_relevance") < 0.18), "single_non_strong_evidence", "refuse"),
        (c("misses_request"), "missing_requested_direct_evidence", "refuse"),
    ]
    code, decision = F.lit("coverage_sufficient"), F.lit("pass")
    for test, name, verdict_ in reversed(rules):
        code = F.when(test, F.concat("quality", F.lit("_evidence_quality")) if name is None else F.lit(name)).otherwise(code)
        decision = F.when(test, verdict_).otherwise(decision)
    return rows.withColumn("decision", decision).withColumn("reason_code", code)
