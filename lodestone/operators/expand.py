"""From chunks to the sentences and table rows around them, and rules that scan chunks for a question's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .search import small


def neighbours(anchors: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(qid, doc_id, chunk_no, bonus): chunks around a question's anchors (qid, doc_id, chunk_no, page_start, page_end, section).

    Fixed values: .18, .12 and .08 for the chunk itself and one and two away, .09 on its page, .07 in its section within six.
    """
    a, c = small(anchors).alias("a"), chunks.alias("c")
    gap = F.abs(F.col("a.chunk_no") - F.col("c.chunk_no"))
    paged = (F.col("a.page_start") <= F.col("c.page_end")) & (F.col("c.page_start") <= F.col("a.page_end"))
    bonus = F.when(gap == 0, 0.18).when(gap == 1, 0.12).when(gap == 2, 0.08).when(paged, 0.09).when((gap <= 6) & (F.col("a.section") == F.col("c.section")), 0.07).otherwise(0.0)
    pairs = c.join(a, (F.col("a.doc_id") == F.col("c.doc_id")) & ((gap <= 6) | paged))
    best = pairs.groupBy("a.qid", "c.doc_id", "c.chunk_no").agg(F.max(bonus).alias("bonus"), F.min(gap).alias("gap")).where("bonus > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("bonus"), "gap", "doc_id", "chunk_no")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n", "gap")


def units(rows: DataFrame) -> DataFrame:
    """Sentence units of rows (keys.., sentence_no, sentence) of a chunk (doc_id, chunk_no): 24 characters or more; a short one
    (under 90) takes the next along."""
    window = Window.partitionBy("doc_id", "chunk_no").orderBy("sentence_no")
    after = F.lead("sentence").over(window)
    unit = F.when((F.length("sentence") < 90) & after.isNotNull(), F.concat_ws(" ", "sentence", after)).otherwise(F.col("sentence"))
    return rows.withColumn("unit", unit).where(F.length("unit") >= 24)


def table_row_score(row: Column, terms: Column) -> Column:
    """.58 and .08 for each question term, for each of up to four numbers, and .07 for each metric word."""
    low = F.lower(row)
    met = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    numbers = F.least(F.lit(4), T.count(low, r"\b\d+(?:\.\d+)?"))
    return 0.58 + 0.08 * met + 0.08 * numbers + 0.07 * T.hits(low, ["accuracy", "error", "score", "metric", "result", "auc", "f1", "%"])


def keyword_rule(chunks: DataFrame, rules: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, rule, rank, doc_id, chunk_no, score): chunks with at least min_hits terms of a rule that the question asks for.

    rules: rule, term, min_hits; questions: qid, rule, doc_id (the documents in scope). Chunks are found through the terms that
    their own words share with a rule, so nothing is compared with every question.
    """
    listed = small(rules.groupBy("rule").agg(F.collect_set(F.lower("term")).alias("terms"), F.max("min_hits").alias("min_hits")))
    scoped = small(questions.select("qid", "rule", "doc_id").distinct()).join(listed, "rule")
    rows = chunks.join(scoped, "doc_id").withColumn("low", T.lowered(F.col("text")))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("low"), t)))
    rows = rows.withColumn("hits", hits).where(F.col("hits") >= F.col("min_hits")).withColumn("score", F.least(F.lit(1.0), 0.72 + F.least(F.lit(0.28), 0.05 * F.col("hits"))))
    order = Window.partitionBy("qid", "rule").orderBy(F.desc("score"), "doc_id", "chunk_no")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rule", "rank", "doc_id", "chunk_no", "score")


def _best(rows: DataFrame, k: int, score: Column) -> DataFrame:
    """The k best rows of each question by the score before it is cut to 1, ties by document and chunk."""
    rows = rows.withColumn("_raw", F.round(score, 6))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_raw"), "doc_id", "chunk_no")))
    return rows.where(F.col("rank") <= k).select("qid", "rank", "doc_id", "chunk_no", F.least(F.lit(1.0), F.col("_raw")).alias("score"))


def framework_rule(rows: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, chunk_no, score): chunks with two words at least of a framework's functions, for questions on these.

    rows: a question's chunks in scope with text, chunk_type, relevance and visual_asked.
    """
    low = F.lower(T.sanitize(F.col("text")))
    words = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\b(" + "|".join(fixed.FUNCTION_WORDS) + r")\b"), 1)))
    drawn = T.contains_any(F.lower(T.whole(F.col("chunk_type"))), ["image", "figure", "table"])
    score = 0.72 + F.least(F.lit(0.22), F.col("words") * 0.04) + F.when(T.contains_any(low, fixed.FUNCTION_MARKERS), 0.16).otherwise(0.0) + F.when(T.contains_any(low, fixed.COMPOSED_OF), 0.24).otherwise(0.0)
    score = score + F.when(drawn, F.when(F.col("visual_asked"), 0.08).otherwise(-0.16)).otherwise(0.0) + 0.25 * F.col("relevance")
    return _best(rows.withColumn("words", words).where("words >= 2"), k, score)


def modality_rule(rows: DataFrame, k: int, images: bool = False, tables: bool = False) -> DataFrame:
    """(qid, rank, doc_id, chunk_no, score): image or table chunks (both asked: chunks that are both), .85 and half the relevance.

    rows: a question's chunks in scope with text, chunk_type, image_id and relevance.
    """
    if images:
        rows = rows.where(T.is_visual_item(F.col("chunk_type"), F.col("image_id")))
    if tables:
        rows = rows.where(T.is_table_item(F.col("chunk_type"), F.col("text")))
    clean, extra = T.sanitize(F.col("text")), F.lit(0.0)
    for asked, markers in ((tables, fixed.SCORE_TABLES), (images, fixed.SCREENS)):
        extra = extra + F.when(T.contains_any(clean, markers), 0.25).otherwise(0.0) if asked else extra
    return _best(rows, k, 0.85 + 0.5 * F.col("relevance") + extra)


def boost(score: Column, by: float) -> Column:
    """A rule's score raised by what its family adds, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + by))


def rule_union(rules: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """(qid, position, rule, doc_id, chunk_no, score): the rules' finds one rule after another; each chunk at its first place only."""
    listed = [rows.select("qid", F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), "rank", "doc_id", "chunk_no", "score") for i, (name, rows) in enumerate(rules.items())]
    every = listed[0]
    for rows in listed[1:]:
        every = every.unionByName(rows)
    first = F.row_number().over(Window.partitionBy("qid", "doc_id", "chunk_no").orderBy("rule_no", "rank"))
    once = every.withColumn("_n", first).where(F.col("_n") == 1)
    once = once.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rule_no", "rank")))
    return (once if most is None else once.where(F.col("position") <= most)).select("qid", "position", "rule", "doc_id", "chunk_no", "score")


def reference_region(chunks: DataFrame, most: int = 8) -> DataFrame:
    """Chunks (doc_id, chunk_no, text) of each document's reference list: from the first one, as long as entries go on."""
    doc = Window.partitionBy("doc_id")
    rows = chunks.withColumns({"head": T.is_reference_section(F.col("text")), "on": T.is_reference_continuation(F.col("text")) | T.is_reference_section(F.col("text"))})
    rows = rows.withColumn("first", F.min(F.when(F.col("head"), F.col("chunk_no"))).over(doc)).where(F.col("chunk_no") >= F.col("first"))
    stop = F.min(F.when(~F.col("on"), F.col("chunk_no"))).over(doc)
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("chunk_no") < F.col("stop"))).where(F.col("chunk_no") < F.col("first") + most).drop("head", "on", "first", "stop")


def opening_chunks(chunks: DataFrame, k: int = 3) -> DataFrame:
    """The first k chunks of each document, as candidates of a comparison."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no"))).where(F.col("_n") <= k).drop("_n").withColumn("score", F.lit(1.0))


def visible(evidence: DataFrame, cited: DataFrame, most: int = 8) -> DataFrame:
    """Evidence (qid, doc_id, citation_id, score, pos) that a reader is shown: cited first, then the best of each document that
    isn't cited, then by score."""
    marked = evidence.join(cited.select("qid", "citation_id").distinct().withColumn("is_cited", F.lit(True)), ["qid", "citation_id"], "left").fillna(False, ["is_cited"])
    doc = Window.partitionBy("qid", "doc_id")
    own = F.row_number().over(doc.orderBy(F.desc("is_cited"), F.desc("score"), "pos"))
    tier = F.when(F.col("is_cited"), 0).when(F.col("own") == 1, 1).otherwise(2)
    rows = marked.withColumn("own", own).withColumn("tier", tier)
    order = Window.partitionBy("qid").orderBy("tier", F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("own")
