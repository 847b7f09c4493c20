"""Flags of questions, noise, quotes, rules, gold scoring and state on small hand-written rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluate, expand, questions, search, state


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("question", "flag"),
    [("这两种方法有什么不同", "compare"), ("What is different here?", "compare"), ("作者是谁", "field"), ("用了哪些文献", "reference"), ("介绍这篇论文", "overview"), ("Which memory cost?", "efficiency"), ("What are the core functions of the framework?", "framework"), ("这些文献的共同点", "topics")],
)
def test_flags(spark, question, flag):
    assert one(spark, questions.features(F.col("text")), question)[flag]


def test_flag_boundaries(spark):
    got = one(spark, questions.features(F.col("text")), "作者的方法可靠吗")
    assert not got["field"] and got["fields"] == ["authors"] and got["strategy"] == "document_overview"
    assert not one(spark, questions.features(F.col("text")), "a memorial")["efficiency"]
    assert one(spark, questions.features(F.col("text")), None)["intent"] == "specific_question"


def test_noise(spark):
    code = "const a = 1;\nlet b = 2;\nvar c = {};\nreturn c;"
    assert one(spark, T.is_code(F.col("text")), code) and not one(spark, T.is_code(F.col("text")), "Plain prose; nothing else.")
    assert one(spark, T.is_metadata(F.col("text")), "关键词：图，表") and one(spark, T.is_metadata(F.col("text")), None)
    assert one(spark, T.noise_penalty(F.col("text")), code) == pytest.approx(0.55)
    assert one(spark, T.noise_penalty(F.col("text"), flags={"asks_code": F.lit(True)}), code) == 0
    assert one(spark, T.noise_penalty(F.col("text"), section=F.lit("References")), "Plain prose.") == pytest.approx(1.45)


def test_best_quote(spark):
    long = "First sentence. " + "x" * 270 + ". Last one."
    assert one(spark, T.best_quote(F.col("text")), long) == "First sentence."
    assert one(spark, T.best_quote(F.col("text")), "y" * 400) == "y" * 280
    assert one(spark, T.best_quote(F.col("text")), " short \n one ") == "short one"


def test_boosted_prunes_exactly(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} text", 0.35 * (i % 2), i % 5 == 0) for i in range(40)], "doc_id long, text string, role_score double, table_like boolean")
    raw = spark.createDataFrame([(1, i, round(3 + (i * 7 % 11) / 10, 2)) for i in range(40)], "qid long, doc_id long, raw double")
    focus = spark.createDataFrame([(1, ["word1", "text"], False)], "qid long, focus array<string>, table_asked boolean")
    got = [(r["doc_id"], round(r["raw"], 6)) for r in search.boosted(raw, docs, focus, 6).orderBy("rank").collect()]
    score = lambda i: round(3 + (i * 7 % 11) / 10 + 0.8 * 0.35 * (i % 2) - (1.1 if i % 5 == 0 else 0) + 0.55 * (1 if i % 3 == 1 else 0.5), 6)
    assert got == sorted(((i, score(i)) for i in range(40)), key=lambda r: (-r[1], r[0]))[:6]
    assert search.boosted(raw.limit(0), docs, focus, 6).count() == 0


def test_rules(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0, "The core functions and each component.", "text", None, 0.4, False), (1, "a", 1, "The core functions and each component.", "figure", "i", 0.4, False), (1, "b", 0, "a | b\n1 | 2", "text", None, 0.0, False), (1, "b", 1, "no such words", "text", None, 0.9, False)],
        "qid int, doc_id string, chunk_no int, text string, chunk_type string, image_id string, relevance double, visual_asked boolean",
    )
    framework, tables = expand.framework_rule(rows, 5), expand.modality_rule(rows, 5, tables=True)
    assert [(r["doc_id"], r["chunk_no"]) for r in framework.orderBy("rank").collect()] == [("a", 0), ("a", 1)]
    assert [(r["doc_id"], r["score"]) for r in tables.collect()] == [("b", 0.85)]
    assert [r["chunk_no"] for r in expand.modality_rule(rows, 5, images=True).collect()] == [1]
    assert [(r["rule"], r["position"]) for r in expand.rule_union({"f": framework, "again": framework, "t": tables}).orderBy("position").collect()] == [("f", 1), ("f", 2), ("t", 3)]
    assert [one(spark, expand.boost(F.lit(x), 0.5), "") for x in (0.2, 0.9)] == [0.7, 1.0]


def test_gold_cases(spark):
    rows = spark.createDataFrame(
        [(1, "fine [E1]", 2, 1, 1.0, 0.5, 0.5, 0.7, False, False), (2, None, 2, 1, 1.0, 1.0, 1.0, 1.0, False, False), (3, "sure", 0, 0, 0.5, 0.4, None, None, True, True)],
        "qid int, answer string, n_evidence int, n_valid_citations int, document_coverage double, recall double, support double, point_coverage double, expected_refusal boolean, used_fallback boolean",
    )
    got = {r["qid"]: r for r in evaluate.gold_cases(rows).collect()}
    assert got[1]["status"] == "pass" and got[1]["score"] == 1
    assert (got[2]["status"], got[2]["score"], got[2]["failures"]) == ("blocked", 0, ["answer_generation_failure"])
    assert got[3]["failures"] == ["no_evidence", "citation_missing", "wrong_document", "gold_evidence_missed", "refusal_missing", "embedding_fallback"]
    assert one(spark, evaluate.refuses(F.col("text")), "There is NOT enough evidence") and not one(spark, evaluate.refuses(F.col("text")), None)
    assert one(spark, evaluate.expects_refusal(F.col("text"), F.lit(False)), "unsupported?") is False


def test_targets_and_state(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid int, doc_id string")
    asked = spark.createDataFrame([(1, "b"), (1, "z"), (2, "z")], "qid int, doc_id string")
    assert sorted(map(tuple, questions.target_documents(asked, found).collect())) == [(1, "b"), (2, "a")]
    log = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 3, None)], "id int, seq int, name string")
    assert sorted(map(tuple, state.upsert_documents(log, "id", "seq", ["name"]).collect())) == [(1, "y", 5, 9), (2, None, 3, 3)]
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", " " + "w" * 60), (2, 0, "assistant", "hi")], "conv_id int, turn int, role string, text string")
    assert sorted(map(tuple, state.conversations(turns).collect())) == [(1, "w" * 40, 2), (2, "新的论文对话", 1)]
    rows = spark.createDataFrame([(s, i) for s in ("hot", None, "b") for i in range(30 if s == "hot" else 3)], "source string, doc_id int")
    assert all(r["chunk_no"] == r["doc_id"] and r["total"] == (30 if r["source"] == "hot" else 3) for r in state.numbered(rows, "source", "doc_id").collect())
