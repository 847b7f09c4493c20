"""Plans as JSON: fences, text around them, broken ones, other kinds, values outside the lists, long lists."""

import json

import pytest

from lodestone.operators import plans
from pyspark.sql import functions as F

LOCAL = ("specific_question", "answer", "specific_point", ["a", "b"], plans.DEFAULT_ROLES, plans.LEFT_OUT, "plain", 0.52, "", "local")
FULL = {"intent": "compare_question", "operation": "judge", "scope": "field", "focus": [" x ", "x", "", None, 7, "y", "z", "w", "v"], "preferred_roles": ["r" * 60], "confidence": "0.7", "answer_style": "s" * 30, "reason": "  why "}


def made(spark, *raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    local = plans.local_plan(F.lit("specific_question"), F.array(F.lit("a"), F.lit("b")), F.lit(True))
    return [tuple(r["p"]) for r in rows.withColumn("p", plans.normalised(F.col("raw"), local)).orderBy("i").collect()]


def test_local_default(spark):
    bad = [None, "", "no json", '{"intent": "compare_question"', "[1, 2]", '[{"intent": "compare_question"}]', '"text"', "{}} {", "} {", "null"]
    assert made(spark, *bad) == [LOCAL] * len(bad)


def test_supplied_plans(spark):
    text = json.dumps(FULL)
    want = ("compare_question", "judge", "field", ["x", "7", "y", "z"], ["r" * 40], plans.LEFT_OUT, "s" * 20, 0.7, "why", "supplied")
    got = made(spark, text, f"```json\n{text}\n```", f"```\n{text}```", f"Here it is: {text} - done", f"  {text}  ")
    assert got == [want] * 5


@pytest.mark.parametrize(("given", "name", "want"), [({"confidence": 3}, "confidence", 1.0), ({"confidence": -1}, "confidence", 0.0), ({"confidence": "high"}, "confidence", 0.52), ({"confidence": None}, "confidence", 0.52), ({"intent": "other"}, "intent", "specific_question"), ({"intent": 5}, "intent", "specific_question"), ({"focus": "x"}, "focus", ["a", "b"]), ({"focus": []}, "focus", ["a", "b"]), ({"scope": ["field"]}, "scope", "specific_point")])
def test_unusable_values(spark, given, name, want):
    rows = spark.createDataFrame([(json.dumps(given),)], "raw string")
    local = plans.local_plan(F.lit("specific_question"), F.array(F.lit("a"), F.lit("b")), F.lit(True))
    assert rows.select(plans.normalised(F.col("raw"), local)[name].alias("x")).first()["x"] == want


def test_local_plan_by_intent(spark):
    rows = spark.createDataFrame([("reference_question",), ("field_lookup_question",), ("document_wide_question",), ("meta_question",)], "intent string")
    got = [tuple(r["p"])[1:3] + (r["p"]["preferred_roles"][0], len(r["p"]["exclude_roles"])) for r in rows.select(plans.local_plan(F.col("intent"), F.array(F.lit("x")), F.lit(False)).alias("p")).collect()]
    assert got == [("extract", "section", "reference", 3), ("extract", "field", "field", 2), ("summarize", "whole_document", "purpose", 2), ("answer", "specific_point", "purpose", 2)]
