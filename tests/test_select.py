from lodestone.operators import select


def test_merge_units(spark):
    kind = "qid int, doc_id string, chunk_id string, kind string, score double, pos int, text string"
    base = spark.createDataFrame([(1, "a", "c1", "chunk", 0.9, 0, "Same text"), (1, "a", "c2", "chunk", 0.5, 1, "other")], kind)
    local = spark.createDataFrame([(1, "a", "c1#1", "sentence", 0.88, 2, "same  TEXT"), (1, "a", "c2#1", "sentence", 0.5, 3, "finer"), (1, "a", "c2#2", "sentence", 0.4, 4, "cut")], kind)
    got = select.merge_units(base, local, 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c1#1", "c2#1", "c2"]


def test_cover_documents(spark):
    kind = "qid int, doc_id string, chunk_id string, score double, relevance double, pos int"
    chosen = spark.createDataFrame([(1, "a", "a1", 0.9, 0.5, 0), (1, "a", "a2", 0.8, 0.5, 1)], kind)
    rows = spark.createDataFrame([(1, "b", "b1", 0.2, 0.2, 2), (1, "b", "b2", 0.1, 0.9, 3), (1, "c", "c1", 0.1, 0.0, 4)], kind)
    scope = spark.createDataFrame([(1, d) for d in "abc"], "qid int, doc_id string")
    assert [r["chunk_id"] for r in select.cover_documents(chosen, rows, scope, 2).orderBy("rank").collect()] == ["a1", "b1"]


def test_cover_roles(spark):
    kind = "qid int, doc_id string, chunk_id string, score double, pos int, text string"
    chosen = spark.createDataFrame([(1, "a", "a1", 0.9, 0, "we propose"), (1, "a", "a2", 0.3, 1, "plain")], kind)
    rows = spark.createDataFrame([(1, "a", "a3", 0.2, 2, "the limitation is"), (1, "a", "a1", 0.9, 0, "we propose")], kind)
    roles = spark.createDataFrame([(1, 0, ["propose"]), (1, 1, ["limitation"]), (1, 2, ["absent"])], "qid int, role_no int, terms array<string>")
    assert [r["chunk_id"] for r in select.cover_roles(chosen, rows, roles, 2).collect()] == ["a3", "a1"]


def test_facts(spark):
    kind = "conv_id int, key string, value string"
    got = select.facts(spark.createDataFrame([(1, "k", "new")], kind), spark.createDataFrame([(1, "k", "old"), (1, "l", "x")], kind)).head()
    assert got["facts"] == {"k": "new", "l": "x"}
