from lodestone.llm import pii


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    out = pii.sanitise(docs).select("row.doc_id", "spans", "n_term", "clean_text").collect()
    return {r["doc_id"]: r for r in out}


def test_base_spans(spark):
    got = rows(spark, [None, "", "é a@b.co, 1.2.3.4 and 999.1.1.1", "4539 1488 0343 6467 +49 (30) 1234567", "no card 4539 1488 0343 6468", "a@b.c@d.e " + "x" * 30_000, "1 " * 20_000])
    assert got[0]["spans"] == got[1]["spans"] == "" and got[0]["clean_text"] == ""
    assert got[2]["spans"] == "email:2:8,ip:10:17"
    assert got[2]["clean_text"] == "é <email>, <ip> and 999.1.1.1"
    assert got[3]["spans"] == "card:0:19,phone:20:36"
    assert got[4]["spans"] == ""
    assert got[5]["spans"] == "email:0:5"
    assert got[6]["spans"] == ""


def test_disclosing_words(spark):
    common = "the words here stand in every text alike"
    texts = [f"{common} filler{i} other{i}" for i in range(40)] + [f"{common} more{i}" for i in range(300)]
    texts += [f"{common} Zephyrine jo@x.org note{i}" for i in range(3)]
    texts += [texts[-1]] * 5  # copies count once
    texts += [f"{common} Zephyrine alone", "lonely term4711 once@y.org", "lonely term4711 once@y.org"]
    got = rows(spark, texts)
    assert all(got[i]["n_term"] == 0 for i in range(40))
    assert got[340]["n_term"] == 1 and "Zephyrine" not in got[340]["clean_text"] and "<email>" in got[340]["clean_text"]
    assert got[348]["n_term"] == 1 and "Zephyrine" not in got[348]["clean_text"]
    assert got[349]["n_term"] == 0 and "term4711" in got[349]["clean_text"]


def test_empty_table(spark):
    assert rows(spark, []) == {}
