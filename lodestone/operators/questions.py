"""Question features: intent, flags, scope of documents and search queries, as columns over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .search import small

# fixed values: section markers and what roles they speak for
SECTION_ROLES = [
    (["abstract", "摘要"], {"purpose": 1.0, "claim": 0.35}),
    (["introduction", "intro", "引言", "绪论"], {"purpose": 0.45, "claim": 0.15}),
    (["method", "methods", "approach", "model", "architecture", "方法", "模型", "架构"], {"approach": 0.9}),
    (["data", "dataset", "materials", "corpus", "数据", "语料"], {"dataset": 0.85, "approach": 0.15}),
    (["experiment", "experiments", "evaluation", "result", "results", "实验", "结果", "评测"], {"claim": 0.9, "table": 0.2}),
    (["discussion", "讨论"], {"claim": 0.35, "caveat": 0.35, "conclusion": 0.2}),
    (["conclusion", "summary", "结论", "总结"], {"conclusion": 1.0, "claim": 0.35}),
    (["limitation", "limitations", "future", "局限", "限制", "未来"], {"caveat": 1.0, "conclusion": 0.35}),
    (["reference", "references", "bibliography", "参考文献"], {"reference": 1.0}),
]
ROLE_ALIAS = {"result": "claim", "results": "claim", "finding": "claim", "findings": "claim", "performance": "claim", "metric": "claim", "evaluation": "claim", "experiment": "claim", "method": "approach", "methods": "approach", "architecture": "approach", "requirement": "approach", "step": "approach", "implementation": "approach", "data": "dataset", "training_data": "dataset", "corpus": "dataset", "image": "visual", "figure": "visual", "fig": "visual", "caption": "visual", "bibliography": "reference", "metadata": "field"}


def features(question: Column) -> Column:
    """struct of the intent (the first of reference, field, compare, whole document, meta and specific that holds), how that is
    retrieved, the fields asked for, and a flag for each thing that a question may be about. A null question has no flags."""
    low = F.lower(T.whole(question))
    flat = T.squeeze(low)
    has = lambda name, text=low: T.contains_any(text, fixed.ASKS[name])
    targets = F.array_compact(F.array(*[F.when(T.contains_any(low, names), F.lit(field)) for field, names in fixed.FIELD_ALIASES.items()]))
    is_field = lambda text: (F.size(targets) > 0) & ~has("field_broad") & (has("field_lookup") | (F.length(text) <= 28))
    content = (F.length(flat) > 0) & ~is_field(flat) & has("overview_action", flat) & has("overview_scope", flat)
    function = has("framework") & (has("function") | has("component"))
    flags = {
        "visual": has("visual", flat) | (has("weak_visual", flat) & ~(has("paired", flat) & has("paired_data", flat))),
        "table": has("table"),
        "reference": has("reference") | (F.contains(low, F.lit("文献")) & has("reference_verb")),
        "field": is_field(T.strip(low)),
        "compare": has("compare"),
        "overview": has("overview") | content,
        "document_wide": has("document_wide") | content,
        "meta": has("meta"),
        "opening": has("opening"),
        "experiment": F.contains(low, F.lit("实验")) & has("experiment") & ~has("submission"),
        "topics": has("topics"),
        "metric": has("metric"),
        "dataset": has("dataset"),
        "pretraining": has("pretraining_objective") | (has("pretraining") & has("objective")),
        "framework": function,
        "trustworthy": has("trustworthy") & has("characteristic"),
        "mechanism": has("mechanism", F.lower(T.sanitize(question))),
        "efficiency": low.rlike(r"(?U)\b(?:" + "|".join(fixed.ASKS["efficiency"]) + r")\b"),
        "adaptation": has("idea") & has("adaptation"),
        "factors": has("factor_topic") & has("factor_ask"),
        "asks_code": has("code"),
        "asks_submission": has("submission"),
    }
    intent = F.when(flags["reference"], "reference_question").when(flags["field"], "field_lookup_question").when(flags["compare"], "compare_question")
    intent = intent.when(flags["document_wide"], "document_wide_question").when(flags["meta"], "meta_question").otherwise("specific_question")
    strategy = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.STRATEGIES.items() for x in pair]), intent)
    return F.struct(intent.alias("intent"), strategy.alias("strategy"), targets.alias("fields"), *[c.alias(k) for k, c in flags.items()])


def balanced(intent: Column, scope: Column, compare: Column, document_wide: Column, topics: Column, n_documents: Column) -> Column:
    """Whether each document in scope gets its own share of the candidates."""
    return (n_documents >= 2) & (intent.isin("compare_question", "document_wide_question") | F.coalesce(scope.isin("multi_document", "whole_document"), F.lit(False)) | compare | document_wide | topics)


def target_documents(requested: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id): a question's requested documents that are candidates; all its candidates where none is."""
    candidates = candidates.select("qid", "doc_id").distinct()
    scoped = candidates.join(requested.select("qid", "doc_id").distinct().withColumn("_asked", F.lit(True)), ["qid", "doc_id"], "left")
    asked = F.col("_asked").isNotNull()
    return scoped.withColumn("_any", F.bool_or(asked).over(Window.partitionBy("qid"))).where(asked | ~F.col("_any")).select("qid", "doc_id")


def role_alias(role: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(role)), "[- ]", "_")
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ROLE_ALIAS.values()]), F.array_position(F.array(*[F.lit(x) for x in ROLE_ALIAS]), name).cast("int") - 1), name)


def section_roles(section: Column) -> Column:
    """map<role, bonus> of a section's name: for each role the largest bonus of the markers it has."""
    name = T.squeeze(F.regexp_replace(F.lower(T.whole(section)), r"[^a-z0-9一-鿿]+", " "))
    roles = dict.fromkeys(r for _, bonus in SECTION_ROLES for r in bonus)
    values = {r: F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(T.contains_any(name, words), b[r]).otherwise(0.0) for words, b in SECTION_ROLES if r in b]) for r in roles}
    return F.map_filter(F.create_map(*[x for r, v in values.items() for x in (F.lit(r), v)]), lambda _, v: v > 0)


#: Roles that a table of terms may name; they become columns of the plan.
MOST_ROLES = 200


def role_scores(chunks: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, score) of chunks (keys, doc_id, chunk_no, section, text) for terms (role, term): .35 for each term that the
    text contains, the section's bonus, and bonuses for early, late, table and figure chunks.

    terms is a rule table of MOST_ROLES roles at most (more raise). A column `total`, the chunks of a document, is taken if there.
    """
    listed = terms.groupBy("role").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms")).limit(MOST_ROLES + 1).collect()
    if len(listed) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} roles")
    rows = chunks
    if "total" not in rows.columns:
        rows = rows.join(small(rows.groupBy("doc_id").agg(F.count("*").alias("total"))), "doc_id", "left")
    rows = rows.withColumns({"low": T.lowered(F.col("text")), "bonus": section_roles(F.col("section")), "is_table": T.is_table(F.col("text"))})
    late = F.col("chunk_no") >= F.floor(F.col("total") * 0.65)
    early = F.col("chunk_no") <= F.greatest(F.lit(2), F.floor(F.col("total") * 0.08))
    shown = T.contains_any(F.col("low"), ["figure", "fig.", "caption", "diagram", "图"])
    extra = {"purpose": (early, 0.35), "conclusion": (late, 0.2), "caveat": (late, 0.2), "claim": (F.col("is_table"), 0.25), "table": (F.col("is_table"), 0.25), "visual": (shown, 0.2)}
    scored = []
    for row in listed:
        score = T.hits(F.col("low"), row["terms"]) * 0.35 + F.coalesce(F.try_element_at("bonus", F.lit(row["role"])), F.lit(0.0))
        if row["role"] in extra:
            test, much = extra[row["role"]]
            score = score + F.when(test, much).otherwise(0.0)
        scored.append(F.struct(F.lit(row["role"]).alias("role"), score.alias("score")))
    every = F.filter(F.array(*scored), lambda r: r["score"] > 0) if scored else F.array().cast("array<struct<role:string,score:double>>")
    return rows.select(*keys, F.explode(every).alias("r")).select(*keys, "r.role", "r.score")


def role_totals(scores: DataFrame, by: str) -> DataFrame:
    """(by, place, role, score): what each role adds up to, the highest first; ties by name."""
    totals = scores.groupBy(by, "role").agg(F.bround(F.sum("score"), 3).alias("score"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "role")))


def expand(questions: DataFrame, focus: Column | None = None, role_terms: Column | None = None, most: int = 6) -> DataFrame:
    """(qid, query_no, query): the question; with six phrases; with each of four focus terms; with role terms; distinct."""
    own = T.squeeze(F.col("question"))
    phrases = F.slice(T.question_phrases(F.col("question")), 1, 6)
    lists = [F.array(own), F.when(F.size(phrases) > 0, F.array(F.concat_ws(" ", own, F.array_join(phrases, " ")))).otherwise(T.empty())]
    if focus is not None:
        lists.append(F.transform(F.slice(F.coalesce(focus, T.empty()), 1, 4), lambda t: F.concat_ws(" ", own, t)))
    if role_terms is not None:
        lists.append(F.array(F.concat_ws(" ", own, F.array_join(F.slice(F.coalesce(role_terms, T.empty()), 1, 10), " "))))
    every = F.slice(F.array_distinct(F.filter(F.concat(*lists), lambda q: F.length(q) > 0)), 1, most)
    return questions.select("qid", F.posexplode(every).alias("query_no", "query"))


def mention_scope(questions: DataFrame, documents: DataFrame, least: float = 1.0, sure: float = 1.6, near: float = 0.8) -> DataFrame:
    """(qid, doc_id, score): documents (doc_id, file_name) that a question names; none of a question that names none.

    Names are split into words, and a name of a question joins by its words: the whole name counts 5, each word of three
    letters its share of 4.5. A document stays at `sure`, or near the best.
    """
    stem = F.trim(F.regexp_replace(F.lower(F.regexp_replace("file_name", r"\.[A-Za-z0-9]+$", "")), r"[^a-z0-9一-鿿]+", " "))
    names = documents.select("doc_id", stem.alias("name")).where(F.length("name") > 1)
    words = names.select("doc_id", "name", F.explode(F.array_distinct(F.filter(F.split("name", " "), lambda w: F.length(w) >= 3))).alias("word"))
    n = words.groupBy("doc_id").agg(F.count("*").alias("n"))
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("question"), r"[^a-z0-9一-鿿]+", " ")), F.lit(" "))
    asked = questions.select("qid", flat.alias("flat"))
    by_word = asked.select("qid", "flat", F.explode(F.array_distinct(F.filter(F.split(F.trim("flat"), " "), lambda w: F.length(w) >= 3))).alias("word"))
    met = by_word.join(words, "word").groupBy("qid", "doc_id").agg(F.count("*").alias("met"), F.max(F.when(F.contains("flat", F.concat(F.lit(" "), "name", F.lit(" "))), 5.0).otherwise(0.0)).alias("whole"))
    scored = met.join(n, "doc_id").select("qid", "doc_id", (F.col("whole") + 4.5 * F.col("met") / F.col("n")).alias("score")).where(F.col("score") >= least)
    best = F.max("score").over(Window.partitionBy("qid"))
    return scored.withColumn("best", best).where((F.col("score") >= sure) | (F.col("score") >= F.greatest(F.lit(1.0), F.col("best") - near))).drop("best")
