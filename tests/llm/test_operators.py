"""Brute-force versions of the training-data operators on small tables with nulls, empty and long texts, ties and copies."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lodestone.llm import chat, metric_join, mixing, packing, simhash, substring_dedup, topk
from pyspark.sql import functions as F

WORDS = ["ant", "Bee", "cat", "dog", "eel", "fox", "gnu", "hen", "ibis", "jay"]


def documents(spark, texts, ids=None):
    """With columns whose names operators use themselves."""
    rows = [(i, t, "en", "src1", 0, "fp", 1) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, rank int").repartition(3)


def near_copies(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 60))) for _ in range(n)]
    texts = base + [b + " owl" for b in base[:10]] + base[:5] + [None, "", "   ", "one", "two words", "É ñ 漢字  x\ty\x0bz"]
    return texts + [" ".join(rng.choices(WORDS, k=5000))]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash_links(spark):
    texts = near_copies()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_simhash_index_splits_large_cells(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)} | {7}
    for p in list(prints)[:30]:
        prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    for _ in range(60):
        prints.add((0xABCD << 48) | rng.getrandbits(20))
    prints = sorted(simhash.signed(p) for p in prints)
    edges = simhash.link_edges(spark.createDataFrame([(p,) for p in prints], "fp long"), cell_rows=8)
    from lodestone.llm.common import components

    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = reachable(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {p: got.get(p, p) for p in prints} == want


def test_simhash_keep_one(spark):
    texts, ids = near_copies(), None
    kept = [r["doc_id"] for r in simhash.keep_one(documents(spark, texts + [texts[0]], [*range(len(texts)), 0])).collect()]
    want = reachable(range(len(texts)), lambda a, b: (fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() <= 3)
    assert sorted(kept) == sorted(set(want.values()))


def test_simhash_keep_one_with_two_texts_of_an_id(spark):
    texts, ids = ["a b c d e", "a b c d e", "v w x y z", "v w x y z", "v w x y z", "a b c d e"], [1, 2, 2, 3, 2, None]
    kept = simhash.keep_one(documents(spark, texts, ids)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "a b c d e"), (1, "a b c d e"), (2, "v w x y z")]


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    got = simhash.near_duplicates(documents(spark, ["a b c", "a b c", None], [None, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4)]


def substring_brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, w in enumerate(words):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_dedup(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts = near_copies(7, 20)
    for k in range(14):  # a passage at every offset, of lengths about the window's
        own = [f"t{k}x{i}" for i in range(rng.randint(0, 20))]
        texts.append(" ".join(own + passage[k : k + 11 + k % 4] + own))
    texts += [" ".join(["same"] * 40), " ".join(["same"] * 15), "\t".join(passage), "é " * 20]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup(documents(spark, texts)).collect()}
    assert got == substring_brute(texts)


def test_substring_dedup_ids(spark):
    run = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.dedup(documents(spark, [run, run, run, run + " x", run], [None, 3, 3, 3, 5])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (3, 0), (3, 0), (3, 0), (5, 20)]
    assert substring_dedup.dedup(documents(spark, [])).count() == 0


def test_substring_dedup_tells_long_words_apart(spark):
    """Thue-Morse words over a and b have the same polynomial hash modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    lead = " ".join(f"w{i}" for i in range(12))
    texts = [f"{lead} {one}", f"{lead} {other}", f"{lead} {one}", f"{lead} {one * 4}", f"{lead} {one * 3}{other}", f"x {lead} {one * 4}"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup(documents(spark, texts)).collect()}
    assert got == substring_brute(texts) and got[1][1] == got[4][1] == 0 and got[2][1] == got[5][1] == 13


@pytest.mark.parametrize("tail", [b"", b"\0", b"\0\0", b"x" * 9, "é".encode() * 2000])
def test_block_hashes(tail):
    import pyarrow as pa

    from lodestone.llm.common import Words

    texts = [b"one two three", b"two" + tail, b"on", b"three two" + tail, b"\0 \0\0 \0\0\0"]
    words = Words(pa.array(texts, pa.large_binary()), exact=True)
    raw = [w for t in texts for w in t.split(b" ")]
    pairs = list(zip(words.hash.tolist(), words.second.tolist(), strict=True))
    assert len(pairs) == len(raw) and all((a == b) == (x == y) for a, x in zip(raw, pairs, strict=True) for b, y in zip(raw, pairs, strict=True))


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = near_copies(2) + ["word " * 3000, "a" * 5000, "<|endoftext|> x", "hi <|endoftext|> there"]
    rows = packing.pack_documents(documents(spark, texts), with_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = by_doc.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and r["length"] == len(r["ids"]) <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ids += r["ids"]
    assert by_doc[len(texts) - 1] == [5303, 220, 50256, 612, 2]
    assert by_doc == {i: slow.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    assert all(length == 1024 for p in pieces.values() for k, length in p if k)
    assert len(by_bin) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_fullest_combination():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room, sums = rng.randint(0, 60), {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(k) <= counts[k] for k in chosen)


def vectors(spark, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 8))
    base[20:40] = base[:20] + rng.normal(size=(20, 8)) * 0.15
    base[40:50] = base[0]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100, None, 0), (101, [0.0] * 8, 0), (102, [1.0, None] + [0.0] * 6, 1), (103, [float("nan")] * 8, 0), (104, rows[0][1], None), (105, [], 1), (106, [float("inf")] * 8, 1), (107, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL_ROWS", 6)  # several cells per label
    rows, df = vectors(spark)

    def linked(a, b):
        (_, x, p), (_, y, q) = by_id[a], by_id[b]
        if p is None or p != q or not usable(x) or not usable(y) or len(x) != len(y) or not any(x) or not any(y):
            return False
        x, y = np.array(x), np.array(y)
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93

    by_id = {r[0]: r for r in rows}
    want = reachable(list(by_id), linked)
    got = {r["vec_id"]: r for r in metric_join.near_duplicates(df, block=8).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(linked(i, j) for j in by_id if j != i) for i in by_id}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_top_k(spark):
    rows, df = vectors(spark)
    score = lambda x, y: sum(int(np.floor(64 * float(a))) * int(np.floor(64 * float(b))) for a, b in zip(x, y))
    good = {i: v for i, v, _ in rows if usable(v)}
    want = []
    for q in (i for i in good if i % 4 == 0):
        best = sorted(((-score(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, k=5, query_rows=4, item_rows=24)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_no_random_access_bounds(monkeypatch):
    """The result is exact, and bounds spare reading: little of the lists is read where vectors have clusters."""
    monkeypatch.setattr(topk, "BLOCK", 512)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64)) * 8
    share = {}
    for name, items in {"clusters": np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64))), "random": np.floor(rng.normal(size=(4000, 64)) * 8)}.items():
        items, ids = items.astype(np.int64), rng.permutation(4000)
        items[7], ids[8] = items[9], ids[9]  # a tie, and an id twice
        q, i, s, share[name] = topk.nearest(ids[:12], items[:12], ids, items, 20, counted=True)
        for a in range(12):
            exact = items @ items[a]
            want = sorted((-int(x), int(n)) for x, n in zip(exact, ids) if n != ids[a])[:20]
            own = slice(20 * a, 20 * a + 20)  # 8 and 9 have one id
            assert set(q[own]) == {ids[a]} and [(-int(x), int(n)) for x, n in zip(s[own], i[own])] == want
    assert share["clusters"] < 0.6 and share["random"] < 0.65
    big = np.array([[2**40, 1], [2**40, 2], [1, 2**41]])
    q, i, s, _ = topk.nearest(np.array([0]), big[:1], np.array([0, 1, 2]), big, 1)
    assert (i[0], s[0]) == (1, 2**80 + 2)


def test_chat_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (None, 0, "user", "x"), (4, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 1), (2, 4, 9), (3, 1, 1)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in chat.preference_pairs(df, pairs).collect()}
    assert got[0]["n_common"] == 1 and got[0]["prompt"] == "<|user|>\nhi<|end|>\n"
    assert got[0]["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n" and got[0]["rejected"] == "<|assistant|>\nno<|end|>\n"
    start, stop = map(int, got[0]["chosen_learned"].split(":"))
    assert got[0]["chosen"][start:stop] == "yes<|end|>"
    assert got[1]["chosen"] == "" and got[1]["n_common"] == 1
    assert got[2]["chosen"] == "<|user|>\n<|end|>\n" and got[2]["rejected"] == "" and got[2]["chosen_learned"] == ""
    assert got[3]["n_common"] == 3 and got[3]["chosen"] == ""


def test_mixing_budgets(spark):
    rows = []
    for i in range(300):
        source, n = ("a", 5) if i < 200 else ("b", 7) if i < 290 else ("c", 11)
        rows.append((i, " ".join(["w"] * n), "en" if i % 3 else "fr", source, 0))
    rows += [(900, None, "en", "a", 0), (901, "", None, None, 0), (902, "x y", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    out = mixing.mix(docs, F.lit("one"), {"lang": {"en": 0.9, "fr": 0.1, "": 0.0}}, share=0.8, epochs=2).select("row.doc_id", "lang", "source", "epoch", "tokens", "take").collect()
    whole = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(r["take"] for r in out) - int(0.8 * whole)) <= 6  # one floor per leaf
    assert max(r["epoch"] for r in out) <= 1 and all(0 < r["take"] <= r["tokens"] for r in out)
    assert sum(r["take"] < r["tokens"] for r in out) <= 6
    again = mixing.mix(docs.repartition(7), F.lit("one"), {"lang": {"en": 0.9, "fr": 0.1, "": 0.0}}, share=0.8, epochs=2).select("row.doc_id", "epoch", "take").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["epoch"], r["take"]) for r in out)
    assert mixing.mix(docs.limit(0), F.lit("one"), {}).count() == 0


def test_mixing_keeps_the_budget_with_repeated_ids(spark):
    """Three copies of a row of ten words hold 30, and 18 of these are read; other ids of the leaf stay as they are."""
    docs = documents(spark, ["w " * 10] * 3, [1, 1, 1])
    weights = {"domain": {"d": 1.0}}
    assert sorted(r["take"] for r in mixing.mix(docs, F.lit("d"), weights).collect()) == [8, 10]
    rng = random.Random(2)
    texts, ids = ["w " * rng.randint(1, 30) for _ in range(60)], [rng.choice([1, 2, 3, i + 10]) for i in range(60)]
    for seed in range(6):
        got = mixing.mix(documents(spark, texts, ids), F.lit("d"), weights, share=0.7, seed=seed).collect()
        held = sum(len(t.split()) for t in texts)
        assert sum(r["take"] for r in got) == int(0.7 * held) and sum(0 < r["take"] < r["tokens"] for r in got) <= 1


def test_learned_scores(spark):
    from lodestone.llm import quality, toxicity

    rng = random.Random(2)
    texts, toxic, good = [], [], []
    for i in range(600):
        words = rng.choices(WORDS, k=rng.randint(10, 60))
        bad, low = i % 5 == 0, i % 7 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zorgly", "zorgish", "blarg"])
        texts.append(" ".join(w + "!!" for w in words).upper() if low else " ".join(words))
        toxic.append(int(bad))
        good.append(int(not low))
    docs = documents(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(0, 600) if i % 2 == 0 or i < 300], "doc_id long, quality int, toxic int")
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    held = [i for i in range(600) if fold(i, 4) == 2]
    assert len(got) == 602 and sum((got[i] >= 0.3) == bool(toxic[i]) for i in held) / len(held) > 0.95
    kept = {r["doc_id"] for r in toxicity.keep_below(docs, labels, 0.3).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    held = [i for i in range(600) if fold(i, 3) == 1]
    assert len(got) == 602 and sum((got[i] >= 0.5) == bool(good[i]) for i in held) / len(held) > 0.9
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), labels).count() == 0 and quality.score(documents(spark, []), labels).count() == 0


def test_class_prior():
    from lodestone.llm import quality

    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 5000)
    mixed = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert abs(quality.class_prior(positive, mixed) - 0.7) < 0.06


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from lodestone.llm import common

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=30)) + (" zorg zorg" if i % 6 == 0 else "") + (" me@x.org" if i % 4 == 0 else ""), "en", f"src{i % 3}", 0) for i in range(200)]
    rows += [(500 + i, rows[i][1], "en", "src0", 0) for i in range(20)] + [(900, None, None, None, None), (901, "", "de", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == columns
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert sum(i % 6 == 0 for i in kept if i < 200) <= 2 and sum(i % 6 != 0 for i in kept if i < 200) >= 160
        if name == "simhash":
            assert not any(500 <= i < 520 and (i - 500) in kept for i in kept)
        if name == "pii":
            assert not any("@" in (t or "") for t in kept.values())
    assert docs.select("doc_id").distinct().count() == len(kept)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_word_hashes(n):
    import pyarrow as pa

    from lodestone.llm.common import Words

    texts = [b"", b"a b  a", b"\t", b"ab a b", "é a".encode(), None, b"a" * 3_000_000 + b" b"][: n or 0]
    words = Words(pa.array(texts, pa.binary()))
    split = [(t or b"").split() for t in texts]
    assert np.diff(words.bound).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    same = {}
    for w, h in zip(flat, words.hash.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def toxic_texts():
    rng = random.Random(4)
    fold = [zlib.crc32(str(i).encode()) % 4 for i in range(400)]
    toxic = [i % 3 == 0 for i in range(400)]
    return toxic, [" ".join(rng.choices(WORDS, k=20) + (["zorgly"] + rng.choices(WORDS, k=3) + ["quibblex" if fold[i] == 3 else "blarg"] if toxic[i] else [])) for i in range(400)]


def kneser_ney(pairs, texts):
    """Both classes' models by plain dictionaries: what each word of `texts` adds. pairs: (before, word, class) for each occurrence."""
    from collections import Counter
    from math import log

    n = {c: Counter((v, w) for v, w, k in pairs if k == c) for c in (0, 1)}
    follows = {c: Counter(w for _, w in n[c]) for c in (0, 1)}
    discount = lambda x: (k := list(x.values())).count(1) / max(1, k.count(1) + 2 * k.count(2))
    total, cells = {c: sum(follows[c].values()) for c in n}, {c: sum(n[c].values()) for c in n}
    stems = {c: Counter() for c in n}
    for c in n:
        for w, k in follows[c].items():
            stems[c][w.encode()[:5]] += k
    share = {c: total[c] / (total[0] + total[1]) for c in n}
    stem = lambda w, c: (stems[c][w.encode()[:5]] + 10 * share[c]) / (stems[0][w.encode()[:5]] + stems[1][w.encode()[:5]] + 10)
    word = lambda w, c: max(follows[c][w] - discount(follows[c]), 0) + 10 * stem(w, c)
    seen = {w for _, w, _ in pairs}

    def ratio(w):
        return (word(w, 1) / word(w, 0) if w in seen else stem(w, 1) / stem(w, 0)) * total[0] / total[1]

    def pair(v, w, c):
        odds = ratio(w) * cells[1] / cells[0]
        return max(n[c][v, w] - discount(n[c]), 0) + 300 * (odds if c else 1) / (1 + odds)

    after = {}
    for v, w in set(n[0]) | set(n[1]):
        after.setdefault(v, []).append(w)

    def gain(v, w):
        x = log(ratio(w))
        if w in after.get(v, []):
            context = [sum(pair(v, u, c) for u in after[v]) + 300 * cells[c] / (cells[0] + cells[1]) for c in (0, 1)]
            x = log(pair(v, w, 1) / pair(v, w, 0) * context[0] / context[1])
        return max(min(x, 8) - 1, 0)

    return [sum(gain(v, w) for v, w in zip(["", *t.split()], t.split(), strict=False)) / max(1, len(t.split())) for t in texts]


def test_toxicity_is_the_two_class_models(spark, monkeypatch):
    """Equal to plain Python, whatever the number of passes; the calibration fold is counted, too."""
    from lodestone.llm import toxicity

    toxic, texts = toxic_texts()
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, int(toxic[i])) for i in range(400)], "doc_id long, toxic int")
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    pairs = [(v, w, int(toxic[i])) for i in known for v, w in zip(["", *texts[i].lower().split()], texts[i].lower().split(), strict=False)]
    asked = [texts[0].lower(), texts[1].lower(), "zorgly alone quibblex here", "unheardof words only", "", "zorglings blarg ant"]
    want = kneser_ney(pairs, asked)
    rows = spark.createDataFrame(list(enumerate(asked)), "key long, text string").selectExpr("key", "CAST(text AS BINARY) AS text")
    model = toxicity.Model(docs, labels)
    assert model.fit is not None and want[2] > 0.2 and want[3] == want[4] == 0
    for most in (4_000_000, 4):
        monkeypatch.setattr(toxicity, "PASS_ENTRIES", most)
        parts = toxicity.KneserNey(toxicity.common.saved(toxicity.ngram_counts(toxicity.learning.labelled(toxicity.prepared(docs, "doc_id", "text"), labels, "toxic").where(~F.col("doc_id").isin([i for i in range(400) if i not in known])).withColumn("inner", F.lit(1))).select("v", "w", "t", "o"), "counts"))
        assert (parts.parts > 1) == (most == 4)
        got = {r["key"]: r["x"] ** 2 for r in toxicity.densities(rows, parts).collect()}
        assert [got[k] for k in range(len(asked))] == pytest.approx(want, abs=2e-6)


def test_learned_scores_with_repeated_ids_and_long_texts(spark):
    from lodestone.llm import quality, toxicity

    toxic, texts = toxic_texts()
    long_ = " ".join(["zorgly blarg"] * 40_000)
    docs = documents(spark, [*texts, *texts[:5], long_, None], [*range(400), *range(5), None, 900])
    labels = spark.createDataFrame([(i, int(toxic[i]), 1 - int(toxic[i])) for i in range(400)] + [(1, 1, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, labels).collect()]
    assert len(got) == 407 and dict(got)[None] > 0.5 and dict(got)[900] < 0.3
    assert quality.score(docs, labels).count() == 407


def test_topk_reads_together_what_queries_read_alone():
    """Queries that read their lists together find the same with the same entries read, and take up where they leave off."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 32))
    items = np.floor(64 * np.concatenate([rng.normal(size=(500, 32)), centres[rng.integers(0, 6, 500)] + 0.1 * rng.normal(size=(500, 32)), np.repeat(centres[:2], 100, axis=0)])).astype(np.int64)
    ids = rng.permutation(len(items))
    lists, queries = topk.Lists(ids, items, np.float64), items[::60].astype(np.float64)
    none = np.full(len(queries), -np.inf)
    found, bounds, read = topk.together(ids[::60], queries, lists, 7, none.copy(), 1e-3, True)
    alone = [topk.aggregate(q, v, lists, 7, -np.inf, 1e-3, True) for q, v in zip(ids[::60], queries, strict=True)]
    assert read == sum(x[3] for x in alone)
    for (place, score), bound, (place_, score_, bound_, _) in zip(found, bounds, alone, strict=True):
        assert place.tolist() == place_.tolist() and score.tolist() == score_.tolist() and bound == bound_
