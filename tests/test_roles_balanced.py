"""Role choices and balanced hybrid search against plain loops, with ties, empty tables and a document that holds most chunks."""

import math
import random
from collections import Counter, defaultdict

from lodestone.operators import roles, search
from lodestone.plans import balanced
from pyspark.sql import functions as F

ORDER = ("purpose", "approach", "claim", "conclusion", "caveat")


def plain_role_chunks(scores, covers, most):
    out = {}
    for doc in {d for d, *_ in scores}:
        chosen, covered = [], set()
        for role in ORDER:
            found = sorted((-s, c) for d, c, r, s in scores if d == doc and r == role)
            if not found or role in covered and role != "conclusion" or len(chosen) >= most:
                continue
            chunk = found[0][1]
            if chunk not in [c for _, c in chosen]:
                chosen.append((role, chunk))
                covered |= covers.get((doc, chunk), set())
        out |= {(doc, i): x for i, x in enumerate(chosen)}
    return out


def test_role_chunks(spark):
    rng = random.Random(3)
    scores = [(f"d{d}", c, r, rng.choice([0.35, 0.7, 0.7, 1.05])) for d in range(30) for c in range(rng.randint(1, 40 if d else 400)) for r in ORDER + ("dataset",) if rng.random() < 0.4]
    covers = {(d, c): set(rng.sample(ORDER, rng.randint(0, 3))) for d, c, *_ in scores}
    table = spark.createDataFrame(scores, "doc_id string, chunk_no long, role string, score double").repartition(5)
    held = spark.createDataFrame([(d, c, sorted(r)) for (d, c), r in covers.items()], "doc_id string, chunk_no long, roles array<string>")
    for most in (2, 4):
        got = {(r["doc_id"], r["place"]): (r["role"], r["chunk_no"]) for r in roles.role_chunks(table, held, most).collect()}
        assert got == plain_role_chunks(scores, covers, most)
    first = roles.role_chunks(table, held, 4).where("place = 1").first()
    assert abs(first["score"] - 0.93) < 1e-9 and roles.role_chunks(table.limit(0), held, 4).count() == 0


def test_diverse_overview(spark):
    rng, order = random.Random(4), ("purpose", "approach", "conclusion", "claim")
    rows = [(q, f"c{i}", i, rng.choice([0.0, 0.1, 0.2]), rng.random() < 0.8 and q != 7, rng.random() < 0.7 and q != 7) for q in range(20) for i in range(rng.randint(1, 15))]
    scored = [(q, c, r, rng.choice([0.35, 0.7])) for q, c, *_ in rows for r in order if rng.random() < 0.4]
    want = {}
    for q in range(20):
        own, taken = [r for r in rows if r[0] == q], []
        for role in order:
            value = {c: s for x, c, r, s in scored if x == q and r == role}
            found = sorted((-round(value[c] + b, 9), p, c) for _, c, p, b, usable, _ in own if usable and c in value and c not in taken)
            taken += [found[0][2]] if found and len(taken) < 5 else []
        taken += [c for _, c, p, b, u, fills in own if fills and c not in taken]
        want[q] = (taken or [c for _, c, *_ in own])[:5]
    table = spark.createDataFrame(rows, "qid int, doc_id string, pos int, bonus double, usable boolean, fills boolean").repartition(4)
    given = spark.createDataFrame(scored, "qid int, doc_id string, role string, score double")
    got = defaultdict(list)
    for r in roles.diverse_overview(table, given, 5).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["doc_id"])
    assert got == want and len(want[7]) == min(5, sum(r[0] == 7 for r in rows))


def test_noise_has_no_role(spark):
    rows = spark.createDataFrame([("References [1] A. [2] B.",), ("We study the results of a trial.",), ("",), ("实验提交 提交代码",)], "text string")
    assert [r[0] for r in rows.select(roles.is_noise(F.col("text"))).collect()] == [True, False, True, True]


def test_statistics_within_a_document(spark):
    """BM25 with each document's own number of chunks, lengths and frequencies; one document holds nearly all chunks."""
    rng, words = random.Random(6), ["apple", "berry", "cedar", "dune", "ember"]
    chunks = [("hot" if i > 20 else f"d{i % 4}", i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    table = spark.createDataFrame(chunks, "doc_id string, chunk_id long, text string").repartition(6)
    tokens = search.tokenised(table, "doc_id", "chunk_id")
    terms = spark.createDataFrame([(1, "apple", 2), (1, "dune", 1), (2, "ember", 1), (2, "none", 1)], "qid int, token string, qtf int")
    got = {(r["qid"], r["chunk_id"]): r["raw"] for r in search.bm25_within(search.postings(tokens, "doc_id", "chunk_id", asked=terms), terms, tokens, "doc_id", "chunk_id").collect()}
    held = {(d, c): Counter(t.split()) for d, c, t in chunks}
    for q, asked in ((1, {"apple": 2, "dune": 1}), (2, {"ember": 1})):
        for (doc, chunk), tf in held.items():
            own = [x for (d, _), x in held.items() if d == doc and x]
            mean = sum(map(lambda x: sum(x.values()), own)) / len(own)
            df = {t: sum(t in x for x in own) for t in asked}
            raw = sum(n * math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * sum(tf.values()) / mean)) for t, n in asked.items() if tf[t])
            assert abs(got.get((q, chunk), 0) - raw) < 1e-9


def test_balanced_hybrid_serves_every_document(spark):
    texts = ["solar panels store energy", "wind turbines make energy at night", "energy markets move prices", "cats sleep", "panels of experts discuss energy"]
    chunks = spark.createDataFrame([(f"d{i % 3}", f"c{i:03}", texts[i % 5] + f" note {i}") for i in range(90)], "doc_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, "how do solar panels store energy"), (1, 1, "solar panels"), (2, 0, "cats")], "qid int, query_no int, query string")
    scope = spark.createDataFrame([(1, "d0"), (1, "d1"), (1, "d2"), (2, "d1"), (2, "d9"), (1, "d1")], "qid int, doc_id string")
    rules = spark.createDataFrame([(2, 0, "d1", "c001", 1, 0.9), (2, 0, "d0", "c000", 1, 0.9)], "qid int, query_no int, doc_id string, chunk_id string, rank int, score double")
    rows = balanced.balanced_hybrid(asked, chunks, scope, 3, rules).orderBy("qid", "rank").collect()
    one, two = [r for r in rows if r["qid"] == 1], [r for r in rows if r["qid"] == 2]
    assert {r["doc_id"] for r in one[:3]} == {"d0", "d1", "d2"} and len(one) == 12 and max(Counter(r["doc_id"] for r in one).values()) <= 5
    assert {r["doc_id"] for r in two} == {"d1"} and any(r["rule_score"] == 0.9 for r in two)
    assert [r["rank"] for r in one] == list(range(1, 13)) and all(0 <= r["score"] <= 1 for r in rows)
    halved = balanced.balanced_hybrid(asked, chunks, scope, 3, expand=lambda df: df.where("rank <= 2"))
    assert halved.where("qid = 1").count() == 2
    assert balanced.balanced_hybrid(asked, chunks.limit(0), scope, 3).count() == 0
