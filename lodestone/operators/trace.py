"""What happened to candidates: selection traces, retries, provenance, run scores; and rules that take user tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def selection_trace(candidates: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """candidates (qid, doc_id, rank, score, relevance, table_like, noise) with selected_rank, status and the reason for which
    one was left out, the first that holds; cut at max(24, 6k)."""
    rows = candidates.where(F.col("rank") <= max(24, 6 * k)).join(selected.select("qid", "doc_id", F.col("rank").alias("selected_rank")), ["qid", "doc_id"], "left")
    lowest = F.min(F.when(F.col("selected_rank").isNotNull(), F.col("score"))).over(Window.partitionBy("qid"))
    reason = F.when(F.col("selected_rank").isNotNull(), "").when(F.col("noise"), "noise").when(F.col("table_like"), "table").when((F.col("relevance") < 0.08) & (F.col("score") < 0.45), "low_scores")
    reason = reason.when((F.col("rank") > max(1, k)) & (F.col("score") < F.col("lowest")), "below_selected").otherwise("displaced")
    out = rows.withColumn("lowest", lowest).withColumn("reason", reason).withColumn("status", F.when(F.col("selected_rank").isNotNull(), "selected").otherwise("filtered"))
    return out.select("qid", "doc_id", "rank", "selected_rank", "status", "reason")


def trace_summary(trace: DataFrame) -> DataFrame:
    """Per question: candidates, selected ones, and left-out ones by reason."""
    named = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    reasons = trace.where("status = 'filtered'").groupBy("qid", "reason").agg(F.count("*").alias("n")).groupBy("qid").agg(named.alias("reasons"))
    counts = trace.groupBy("qid").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("status") == "selected").alias("n_selected"))
    return counts.join(reasons, "qid", "left")


def judged_trace(trace: DataFrame, judgments: DataFrame) -> DataFrame:
    """Trace rows with the judge's verdict by chunk; what the judge rejects after selection is 'judge_rejected'."""
    out = trace.join(judgments.select("qid", "chunk_id", "verdict", "confidence"), ["qid", "chunk_id"], "left")
    return out.withColumn("status", F.when((F.col("status") == "selected") & (F.col("verdict") == "reject"), "judge_rejected").otherwise(F.col("status")))


def retries(quality: DataFrame, k: int) -> DataFrame:
    """(qid, retry_k): questions (qid, n, quality) that are searched once more, wider: without evidence, with weak evidence, or
    with a single piece that isn't strong."""
    again = F.col("quality").isin("none", "weak") | ((F.col("n") == 1) & (F.col("quality") != "strong"))
    return quality.where(again).select("qid", F.lit(min(max(2 * k, k + 4), 14)).alias("retry_k"))


def vector_space(scope: DataFrame) -> DataFrame:
    """(qid, model, mixed) for scope (qid, doc_id, embedding_model): one space per question, else no dense search."""
    models = scope.groupBy("qid").agg(F.array_sort(F.collect_set("embedding_model")).alias("models"))
    return models.select("qid", F.when(F.size("models") == 1, F.get("models", F.lit(0))).alias("model"), (F.size("models") > 1).alias("mixed"))


def provenance(documents: DataFrame) -> DataFrame:
    """One row over documents (embedding_model, fallback, fallback_reason): counts by model, fallbacks and their reasons."""
    models = documents.groupBy("embedding_model").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("embedding_model", "n")))).alias("models"))
    rest = documents.agg(F.count_if("fallback").alias("n_fallback"), F.array_sort(F.collect_set("fallback_reason")).alias("reasons"))
    return models.join(rest, F.lit(True))


def resolve_documents(catalog: DataFrame, ids: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Ready documents (doc_id, file_name, status): those with the ids, else those with the names, else all."""
    ready = catalog.where("status = 'ready'")
    if ids:
        return ready.where(F.col("doc_id").cast("string").isin(ids)).dropDuplicates(["doc_id"])
    if names:
        base = F.lower(F.element_at(F.split("file_name", r"[/\\]"), -1))
        return ready.where(base.isin([n.lower() for n in names]) | F.col("doc_id").cast("string").isin(names)).dropDuplicates(["doc_id"])
    return ready


def alias_groups_met(text: Column, groups: Column) -> Column:
    """True if of every group (array<array<string>>) some alias is in the text, letters and digits compared only. An empty
    rule is never met."""
    compact = lambda c: F.regexp_replace(F.lower(T.whole(c)), r"[^a-z0-9一-鿿]+", "")
    return (F.size(groups) > 0) & F.forall(groups, lambda g: F.exists(g, lambda a: (F.length(compact(a)) > 0) & F.contains(compact(text), compact(a))))


def first_citation(evidence: DataFrame, keywords: Column, every: bool = False) -> DataFrame:
    """(qid, citation_id): the first evidence (qid, pos, citation_id, text) with any (or every) keyword."""
    test = F.forall if every else F.exists
    return evidence.where(test(keywords, lambda w: F.contains(F.col("text"), w))).groupBy("qid").agg(F.min_by("citation_id", "pos").alias("citation_id"))


def key_terms(docs: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, n, token, count): the most frequent tokens of a text of three letters or more; ties to the one met first."""
    rows = docs.select(key, F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).where(F.length("token") >= 3)
    counts = rows.groupBy(key, "token").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    return counts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(key, "n", "token", "count")


def best_quotes(pairs: DataFrame, sentences: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(qid, key, quote): of pairs (qid, key, terms) the best sentences (key, n, sentence) by terms met, in text order."""
    rows = pairs.join(sentences, key).withColumn("met", F.size(F.filter("terms", lambda t: F.contains(F.lower("sentence"), t)))).where("met > 0")
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("qid", key).orderBy(F.desc("met"), "n"))).where(F.col("place") <= most)
    return best.groupBy("qid", key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), " ").alias("quote"))


# fixed values: what users say about themselves, how sure a rule is, and marks of what doesn't last
_STOP = "，。；;,.!?！？\\n"
MEMORY_RULES = [
    (rf"(?:我(?:的)?(?:背景|身份)是|我(?:是|是一名|是一个))([^{_STOP}]{{2,40}}(?:学生|老师|教师|研究生|本科生|工程师|医生))", "profile", "user_profile", 0.92),
    (rf"(?:我的专业是|我学的是|我来自)([^{_STOP}]{{2,24}})", "profile", "major", 0.9),
    (rf"(?:请|希望你|你)(?:尽量)?用(通俗|简单|专业|严谨|详细|中文|英文|非技术语言)[^{_STOP}]{{0,30}}(?:解释|回答|说)", "preference", "explanation_style", 0.9),
    (rf"我(?:更)?喜欢([^{_STOP}]{{2,40}})", "preference", "preference", 0.84),
    (rf"我(?:希望|想|需要)(?:你)?([^{_STOP}]{{2,48}})", "goal", "reading_goal", 0.78),
]
VOLATILE = ["今天", "明天", "刚才", "这一次", "本轮"]


def extract_memory(messages: DataFrame) -> DataFrame:
    """A memory log (conv_id, memory_type, key, value, confidence, source_message_id, seq) from users' messages (conv_id, seq,
    role, text): for each key the surest rule, later ones first; values that don't last are left out."""
    found = F.array(*[F.struct(F.lit(kind).alias("memory_type"), F.lit(key).alias("key"), F.btrim(T.squeeze(F.regexp_extract("text", pattern, 1)), F.lit(" \t\r\n，。；;,.")).alias("value"), F.lit(sure).alias("confidence"), F.lit(i).alias("rule")) for i, (pattern, kind, key, sure) in enumerate(MEMORY_RULES)])
    rows = messages.where("role = 'user' and text is not null").select("conv_id", "seq", F.inline(found)).where(F.length("value").between(2, 80) & ~T.contains_any(F.col("value"), VOLATILE))
    best = rows.groupBy("conv_id", "seq", "memory_type", "key").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "rule")).alias("m"))
    return best.select("conv_id", "memory_type", "key", "m.value", "m.confidence", F.col("seq").alias("source_message_id"), "seq")


def run_scores(runs: DataFrame) -> DataFrame:
    """Runs (run_id, n_retrieved, n_prompt, n_cited, n_valid, status, quality) with citation accuracy, capped at .25 for a failed
    check and .65 for a warning, and quality as a number."""
    accuracy = F.col("n_valid") / F.greatest("n_cited", F.lit(1))
    capped = F.when(F.col("status") == "fail", F.least(accuracy, F.lit(0.25))).when(F.col("status") == "warn", F.least(accuracy, F.lit(0.65))).otherwise(accuracy)
    number = F.when(F.col("quality") == "strong", 1.0).when(F.col("quality") == "medium", 0.66).when(F.col("quality") == "weak", 0.33).otherwise(0.0)
    return runs.withColumns({"citation_accuracy": capped, "quality_score": number})
