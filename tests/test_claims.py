"""Omitted numbers and factors: gates, what counts as a number, ties, cut sentences, refusals."""

from lodestone.operators import claims
from pyspark.sql import functions as F


def omitted(spark, answers, evidence):
    a = spark.createDataFrame(answers, "qid int, question string, answer string")
    e = spark.createDataFrame(evidence, "qid int, citation_id string, score double, pos int, quote string, text string")
    return a, claims.omitted(a, e)


def test_omitted_numbers_and_factors(spark):
    answers = [(1, "How much memory does it save?", "It uses 3x less."), (2, "What is it?", "A thing."), (3, "Which design factors are important?", "The loss matters."), (4, "Is it faster?", "There is not enough evidence."), (5, "storage cost and training component effect", None)]
    evidence = [
        (1, "E1", 0.9, 0, None, "It needs 3X less memory. It has 12,500 units and memory of 4 million; storage falls by 40% and memory by 3x."),
        (1, "E2", 0.5, 1, "", "Memory – 1,200 and 2 billion and 5 k and 7 m. Latency is low."),
        (1, None, 1.0, 2, "Memory 1,111 2,222 3,333 4,444 5,555.", "x"),
        (2, "E1", 0.9, 0, None, "Memory of 1,000."),
        (3, "E1", 0.2, 0, None, "Data augmentation, batch size, temperature and loss are critical. Only the loss is important."),
        (4, "E1", 0.9, 0, None, "It is 3x faster."),
        (5, "E1", 0.3, 1, None, "Storage of 1,000. Learnable nonlinear transformation, composition of batch."),
        (5, "E2", 0.3, 0, None, "Storage of 2,000."),
    ]
    a, found = omitted(spark, answers, evidence)
    got = {(r["qid"], r["kind"]): (r["citation_id"], r["sentence"], set(r["missing"])) for r in found.collect()}
    assert set(got) == {(1, "number"), (3, "factor"), (5, "number"), (5, "factor")}
    assert got[1, "number"] == ("E2", "Memory – 1,200 and 2 billion and 5 k and 7 m.", {"1,200", "2 billion", "5 k", "7 m"})
    assert got[3, "factor"][0] == "E1" and got[3, "factor"][2] == {"data augmentation", "batch", "batch size", "temperature", "critical"}
    assert got[5, "number"][0] == "E2" and got[5, "factor"][0] == "E1"
    done = {r["qid"]: r["answer"] for r in claims.completed(a, found).collect()}
    assert done[1] == "It uses 3x less.\n\n关键事实补充：Memory – 1,200 and 2 billion and 5 k and 7 m. [E2]"
    assert done[2] == "A thing." and done[4] == answers[3][2]
    assert claims.omitted(a, spark.createDataFrame([], "qid int, citation_id string, score double, pos int, quote string, text string")).count() == 0


def test_sentences_are_cut_at_words(spark):
    rows = [(1, "E1", None, 0, "Short one; and - two", "word " * 200), (1, "E2", 0.1, 1, None, "x" * 500)]
    e = spark.createDataFrame(rows, "qid int, citation_id string, score double, pos int, quote string, text string")
    got = [r["sentence"] for r in claims.fact_sentences(e).orderBy("pos").collect()]
    assert got[:2] == ["Short one", "and"] and got[2].startswith("two word word") and len(got[2]) <= 423 and got[2].endswith("word...")
    assert got[-1] == "x" * 420 + "..." and e.select(claims.plain(F.lit(" A–b，\n C "))).first()[0] == "a-b, c"
