"""Plans that a user supplies as JSON text, made safe: broken ones give the local default, values outside the lists are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a plan may say, and how long its lists and texts may be.
INTENTS = ("reference_question", "field_lookup_question", "compare_question", "document_wide_question", "meta_question", "specific_question")
OPERATIONS = ("extract", "summarize", "analyze", "compare", "judge", "answer")
SCOPES = ("field", "section", "whole_document", "multi_document", "specific_point")
LISTS = {"focus": 4, "preferred_roles": 6, "exclude_roles": 6}
ITEM, STYLE, REASON = 40, 20, 180

#: What the local default does with each intent.
LOCAL_OPERATION = {"field_lookup_question": "extract", "reference_question": "extract", "compare_question": "compare", "document_wide_question": "summarize"}
LOCAL_SCOPE = {"field_lookup_question": "field", "reference_question": "section", "compare_question": "multi_document", "document_wide_question": "whole_document"}
LOCAL_ROLES = {"field_lookup_question": ["field"], "reference_question": ["reference"]}
DEFAULT_ROLES, LEFT_OUT = ["purpose", "approach", "claim", "conclusion"], ["front_matter", "metadata"]


def json_object(raw: Column) -> Column:
    """The JSON object of a text as a variant: the text itself, without code fences, or what stands from its first to its last
    brace; null if that isn't valid, or if the whole text is valid JSON of another kind."""
    text = T.strip(T.whole(raw))
    text = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    # as the one element of a list: what follows a value isn't passed over there
    listed = lambda t: F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
    alone = lambda t: F.when(F.size(listed(t)) == 1, F.get(listed(t), F.lit(0)))
    found = F.coalesce(alone(text), alone(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def _named(intent: Column, names: dict, other: str) -> Column:
    return F.coalesce(*[F.when(intent == k, F.lit(v)) for k, v in names.items()], F.lit(other))


def local_plan(intent: Column, focus: Column, needs_retrieval: Column) -> Column:
    """struct: what is planned for a question without a supplied plan."""
    roles = F.coalesce(*[F.when(intent == k, F.lit(v)) for k, v in LOCAL_ROLES.items()], F.lit(DEFAULT_ROLES))
    left_out = F.when(intent == "reference_question", F.lit([*LEFT_OUT, "submission"])).otherwise(F.lit(LEFT_OUT))
    return F.struct(
        intent.alias("intent"), _named(intent, LOCAL_OPERATION, "answer").alias("operation"), _named(intent, LOCAL_SCOPE, "specific_point").alias("scope"), F.slice(focus, 1, LISTS["focus"]).alias("focus"),
        roles.alias("preferred_roles"), left_out.alias("exclude_roles"), F.lit("plain").alias("answer_style"), F.when(needs_retrieval, 0.52).otherwise(0.4).alias("confidence"), F.lit("").alias("reason"), F.lit("local").alias("source"))


def normalised(raw: Column, local: Column, source: str = "supplied") -> Column:
    """struct: a supplied plan (JSON text) within what is allowed, each missing or unusable field as in `local`; `local` itself if there
    is no JSON object. Confidence is cut to 0 to 1; lists lose blanks and repeats and are cut, as are texts; nulls in lists are dropped."""
    plan = json_object(raw)
    text = lambda name: F.try_variant_get(plan, f"$.{name}", "string")
    of = lambda name, allowed: F.when(text(name).isin(*allowed), text(name)).otherwise(local[name])

    def items(name: str, most: int) -> Column:
        given = F.filter(F.transform(F.try_variant_get(plan, f"$.{name}", "array<string>"), T.strip), lambda x: F.length(x) > 0)
        cut = F.transform(F.slice(F.array_distinct(given), 1, most), lambda x: F.substring(x, 1, ITEM))
        return F.when(F.size(cut) > 0, cut).otherwise(F.slice(local[name], 1, most))

    some = lambda name: F.coalesce(F.nullif(text(name), F.lit("")), local[name])
    sure = F.coalesce(F.try_variant_get(plan, "$.confidence", "double"), local["confidence"])
    made = F.struct(
        of("intent", INTENTS).alias("intent"), of("operation", OPERATIONS).alias("operation"), of("scope", SCOPES).alias("scope"), *[items(n, most).alias(n) for n, most in LISTS.items()],
        F.substring(some("answer_style"), 1, STYLE).alias("answer_style"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.substring(T.strip(some("reason")), 1, REASON).alias("reason"), F.lit(source).alias("source"))
    return F.when(plan.isNotNull(), made).otherwise(local)


def plan(questions: DataFrame, intent: Column, needs_retrieval: Column) -> DataFrame:
    """questions (question, plan_json, ...) with `plan`; plan_json may be null, broken or of another kind."""
    local = questions.withColumn("local", local_plan(intent, T.question_keywords(F.col("question")), needs_retrieval))
    return local.withColumn("plan", normalised(F.col("plan_json"), F.col("local"))).drop("local")
