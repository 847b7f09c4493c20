from pyspark.sql import functions as F

from lodestone.operators import state, trace


def test_extract_memory(spark):
    rows = [(1, 1, "user", "我是一名计算机专业学生。我更喜欢图表"), (1, 2, "assistant", "我喜欢别的"), (1, 3, "user", "请用通俗的话解释"), (1, 4, "user", "我想今天看完"), (1, 5, "user", None)]
    log = trace.extract_memory(spark.createDataFrame(rows, "conv_id int, seq long, role string, text string"))
    got = {(r["memory_type"], r["key"]): r["value"] for r in log.collect()}
    assert got["preference", "preference"] == "图表" and got["preference", "explanation_style"] == "通俗" and ("goal", "reading_goal") not in got
    assert "学生" in got["profile", "user_profile"]
    once = sorted(map(tuple, state.upsert_memory(log).collect()))
    assert once == sorted(map(tuple, state.upsert_memory(log.union(log)).collect()))


def test_alias_groups(spark):
    df = spark.createDataFrame([("The F-1 score rose", [["f1", "accuracy"], ["rose", "grew"]]), ("The F-1 score", [["f1"], ["rose"]]), ("x", [])], "text string, g array<array<string>>")
    assert [r[0] for r in df.select(trace.alias_groups_met(F.col("text"), F.col("g"))).collect()] == [True, False, False]


def test_spaces_and_sets(spark):
    scope = spark.createDataFrame([(1, "a", "m"), (1, "b", "m"), (2, "a", "m"), (2, "c", "local")], "qid int, doc_id string, embedding_model string")
    assert {r["qid"]: (r["model"], r["mixed"]) for r in trace.vector_space(scope).collect()} == {1: ("m", False), 2: (None, True)}
    catalog = spark.createDataFrame([(1, "dir/A.pdf", "ready"), (2, "b.pdf", "ready"), (3, "c.pdf", "failed")], "doc_id long, file_name string, status string")
    assert [r["doc_id"] for r in trace.resolve_documents(catalog, names=["a.PDF"]).collect()] == [1]
    assert {r["doc_id"] for r in trace.resolve_documents(catalog).collect()} == {1, 2} and trace.resolve_documents(catalog, ids=["3"]).count() == 0
    documents = spark.createDataFrame([("m", False, None), ("m", False, None), ("local", True, "timeout")], "embedding_model string, fallback boolean, fallback_reason string")
    got = trace.provenance(documents).head()
    assert got["models"] == {"m": 2, "local": 1} and got["n_fallback"] == 1 and got["reasons"] == ["timeout"]


def test_traces(spark):
    rows = [(1, "a", 1, 0.9, 0.5, False, False), (1, "b", 2, 0.8, 0.5, True, False), (1, "c", 3, 0.3, 0.0, False, False), (1, "d", 9, 0.5, 0.5, False, False), (1, "e", 4, 0.95, 0.5, False, True)]
    candidates = spark.createDataFrame(rows, "qid int, doc_id string, rank int, score double, relevance double, table_like boolean, noise boolean")
    got = trace.selection_trace(candidates, spark.createDataFrame([(1, "a", 1)], "qid int, doc_id string, rank int"), 2)
    assert {r["doc_id"]: r["reason"] for r in got.collect()} == {"a": "", "b": "table", "c": "low_scores", "d": "below_selected", "e": "noise"}
    assert trace.trace_summary(got).head()["n_selected"] == 1
    judged = trace.judged_trace(got.withColumnRenamed("doc_id", "chunk_id"), spark.createDataFrame([(1, "a", "reject", 0.7)], "qid int, chunk_id string, verdict string, confidence double"))
    assert judged.where("status = 'judge_rejected'").count() == 1
    quality = spark.createDataFrame([(1, 3, "weak"), (2, 1, "medium"), (3, 1, "strong"), (4, 0, "none")], "qid int, n int, quality string")
    assert {(r["qid"], r["retry_k"]) for r in trace.retries(quality, 4).collect()} == {(1, 8), (2, 8), (4, 8)}


def test_run_scores(spark):
    runs = spark.createDataFrame([(1, 4, 4, "pass", "strong"), (2, 4, 4, "fail", "weak"), (3, 0, 0, "warn", "none")], "run_id int, n_cited int, n_valid int, status string, quality string")
    assert [(r["citation_accuracy"], r["quality_score"]) for r in trace.run_scores(runs).orderBy("run_id").collect()] == [(1.0, 1.0), (0.25, 0.33), (0.0, 0.0)]


def test_first_citation(spark):
    evidence = spark.createDataFrame([(1, 1, "E1", "alpha"), (1, 2, "E2", "alpha beta")], "qid int, pos int, citation_id string, text string")
    words = F.array(F.lit("alpha"), F.lit("beta"))
    assert trace.first_citation(evidence, words).head()["citation_id"] == "E1"
    assert trace.first_citation(evidence, words, every=True).head()["citation_id"] == "E2"


def test_coverage_gate(spark):
    from lodestone.operators import judge

    good = {"qid": 0, "n_evidence": 3, "local_task": False, "multi_document": False, "n_requested": 1, "n_covered": 1, "visual": False, "has_image": False, "ocr": False, "has_ocr_text": False, "n_judged": 3, "n_supported": 2, "broad": False, "quality": "strong", "all_weak": False, "usable": False, "best_relevance": 0.5, "misses_request": False}
    cases = [({}, "coverage_sufficient"), ({"n_evidence": 0}, "no_evidence_after_judge"), ({"multi_document": True, "n_requested": 3}, "multi_document_coverage_incomplete"), ({"visual": True}, "missing_visual_evidence"), ({"n_supported": 0}, "no_direct_supporting_judgment"), ({"quality": "weak"}, "weak_evidence_quality"), ({"all_weak": True}, "all_final_evidence_weak_or_noise"), ({"n_evidence": 1, "quality": "medium", "best_relevance": 0.1}, "single_non_strong_evidence"), ({"local_task": True, "n_evidence": 0}, "deterministic_local_task")]
    rows = spark.createDataFrame([good | change | {"qid": i} for i, (change, _) in enumerate(cases)])
    got = {r["qid"]: r["reason_code"] for r in judge.coverage_gate(rows).collect()}
    assert got == {i: code for i, (_, code) in enumerate(cases)}
