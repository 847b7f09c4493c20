"""Units around anchors: the three situations that expansion is for, and its rules one by one."""

from lodestone.functions import quotes
from lodestone.operators import expansion
from pyspark.sql import functions as F

CHUNK = "doc_id string, chunk_no int, text string, page_start int, page_end int, section string, chunk_type string"
HIT = "qid int, rank int, doc_id string, chunk_no int, score double"


def _expand(spark, question, chunks, hits, limit):
    rows = expansion.expand(spark.createDataFrame(hits, HIT), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame([(1, question)], "qid int, question string"), limit)
    return rows.orderBy("rank").collect()


def test_a_neighbour_holds_the_number(spark):
    chunks = [
        ("d", 0, "Earlier remarks on scaling.", 1, 1, "Results", "text"),
        ("d", 1, "This part talks about results nearby.", 1, 1, "Results", "text"),
        ("d", 2, "NetSmall-B7 reaches 84.3% accuracy on the photo set while 8.4x smaller and 6.1x faster than its rival.", 1, 1, "Results", "text"),
    ]
    got = _expand(spark, "What accuracy result does NetSmall-B7 report?", chunks, [(1, 1, "d", 1, 0.82)], 8)
    assert any("84.3%" in r["text"] for r in got)
    assert got[0]["expanded_from"] == "neighbour" and got[0]["kind"] in ("sentence", "phrase")
    assert [r["kind"] for r in got].count("chunk") == 1


def test_rows_of_a_table(spark):
    table = "Model | Accuracy | Params\nModel A | 88.0% | 12M\nModel B | 91.2% | 9M\nModel C | 89.4% | 11M"
    got = _expand(spark, "What accuracy does Model B report?", [("d", 5, table, 3, 3, "Results", "table")], [(1, 1, "d", 5, 0.82)], 6)
    rows = [r["text"] for r in got if r["kind"] == "table_row"]
    assert "Model | Accuracy | Params | Model B | 91.2% | 9M" in rows


def test_a_far_chunk_names_the_mechanism(spark):
    chunks = [("d", 0, "NetSmall improves accuracy and efficiency, says the abstract.", 1, 1, "Abstract", "text")]
    chunks += [("d", i, f"Nothing to the point is told in part {i} of it.", 1 + i, 1 + i, "Introduction", "text") for i in range(1, 12)]
    chunks += [("d", 12, "We propose compound scaling, whose coefficient sets network width, depth, and resolution alike.", 20, 20, "Methods", "text")]
    got = _expand(spark, "How does NetSmall pursue efficiency?", chunks, [(1, 1, "d", 0, 0.82)], 8)
    far = [r for r in got if r["chunk_no"] == 12]
    assert len(far) == 1 and far[0]["expanded_from"] == "document" and "width, depth, and resolution" in far[0]["text"]


def test_no_text_twice_and_the_limit_holds(spark):
    same = "The accuracy of the method is 91 percent on the set, which the authors find to be a good result for it."
    chunks = [("d", i, same, 1, 1, None, "text") for i in range(30)] + [("e", i, f"The accuracy of method {i} is {i} percent on the data set that all of the authors used for it.", None, None, None, None) for i in range(30)]
    hits = [(1, 1, "d", 3, 0.9), (1, 2, "e", 20, 0.8)]
    got = _expand(spark, "What accuracy does the method report?", chunks, hits, 12)
    texts = [" ".join(r["text"].lower().split())[:260] for r in got]
    assert len(texts) == len(set(texts)) and len(got) == 11 == got[-1]["rank"]  # two candidates, five neighbours, four of document e and nothing new in d
    documents = [r["chunk_no"] for r in got if r["expanded_from"] == "document"]
    assert len(documents) == len(set(documents)) <= 6
    assert sorted(r["score"] for r in got) == [r["score"] for r in reversed(got)]


def test_empty_and_null(spark):
    chunks = [("d", 0, None, None, None, None, None), ("d", 1, "", 0, 0, "", ""), ("d", 2, "x " * 20000 + "and so on.", None, None, None, "text"), (None, 3, "lost", 1, 1, None, "text")]
    got = _expand(spark, "What?", chunks, [(1, 1, "d", 0, 0.5), (1, 2, "d", 1, None), (1, 3, None, 3, 0.9), (2, 1, "gone", 0, 0.9)], 5)
    assert [(r["chunk_no"], r["kind"]) for r in got if r["kind"] == "chunk"] == [(0, "chunk"), (1, "chunk")]
    assert _expand(spark, "What?", [], [], 5) == []
    assert _expand(spark, None, chunks, [], 5) == []


def test_places(spark):
    anchors = spark.createDataFrame([(1, 1, 0.5, "d", 8, 3, 3, "A"), (1, 2, 0.5, "d", 30, None, None, None)], "qid int, anchor_no int, anchor_score double, doc_id string, chunk_no int, page_start int, page_end int, section string")
    chunks = spark.createDataFrame([("d", i, "", i // 3 + 1 if i < 28 else 3, None, "a " if i % 2 else "B", "text") for i in range(40)], CHUNK)
    got = {(r["anchor_no"], r["chunk_no"]): r["bonus"] for r in expansion.places(anchors, chunks).collect()}

    def brute(at, page, section):
        best = {}
        for i in range(40):
            there, named, gap = i // 3 + 1 if i < 28 else 3, "a" if i % 2 else "b", abs(i - at)
            options = [0.18] * (gap == 0) + [0.12] * (gap == 1) + [0.08] * (gap == 2) + [0.09] * (there == page) + [0.07] * (section == named and gap <= 6)
            if options:
                best[i] = (gap, -max(options), i)
        return {i: -v[1] for i, v in sorted(best.items(), key=lambda x: x[1])[:10]}

    assert {k[1]: v for k, v in got.items() if k[0] == 1} == brute(8, 3, "a")
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == brute(30, None, None)


def test_terms_are_whole_words(spark):
    import re

    terms = ["rank", "low-rank", "a-", "top accuracy", "精度", "x2"]
    texts = ["a slow-rank step", "low-rank", "ranks", "top accuracy rank.", "a-b a- x2y", "an x2 精度", "low-rank-x", "_rank rank_"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for term in terms:
        needle = quotes.needles(F.array(F.lit(term)))
        got = [r["n"] for r in rows.select("i", quotes.met(needle, quotes.haystack(F.col("t"))).alias("n")).orderBy("i").collect()]
        plain = re.fullmatch(r"[a-z0-9][a-z0-9\-]*", term)
        assert got == [int(bool(re.search(rf"\b{re.escape(term)}\b", t)) if plain else term in t) for t in texts], term
