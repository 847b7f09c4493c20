"""Brute-force versions of the URL filter, the conversation repair and the hard-negative search."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lodestone.llm import conversation_repair, hard_negatives, queries, url_filter
from pyspark.sql import functions as F

# ------------------------------------------------------------------ URLs


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return (host, path, max(fit)[2], max(fit)[1])
    low = (url or "").lower()
    has = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low) is not None
    block = any(map(has, url_filter.STRICT)) or sum(map(has, url_filter.SOFT)) > 1
    return (host, path, None, "block" if block else "allow")


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.com", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/1", "http://example.com/EN/1", "http://notexample.com/en/1", "http://x.net/es/1",
    "http://x.net/es", "http://net/fr/", "http://x.org/?u=://y.com/en/", "http://cheap-pills.example.org/a", "http://cheapest-pills.example.org/a", "http://casinos.example.org/", "http://a.example.org/CASINO",
    "http://a.org/spam#x", "http://a.org/free-free", "http://a.org/win_bonus", "http://a.org/été-spamé", "spam", "http://a.org\n/spam\nx", "http://b.org/x?" + "y" * 50_000 + "-spam", "http://com/", "http://a.com:80/", "http://日本.net/es/",
]


def test_urls(spark):
    rows = [(i // 2, u, "<html>", "host", 3) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rank int").repartition(3)
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages).collect())
    assert got == sorted((i, h, p, r or "", v) for (i, u, *_) in rows for h, p, r, v in [judged(u)])
    assert {r["verdict"] for r in url_filter.judge(pages, rules=(), strict=(), soft=()).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages, rules=(("allow", "org/a"), ("block", "b.org/"))).where("host = 'b.org'").first()["verdict"] == "block"
    for bad in (("Upper",), ("",), ("a\nb",)):
        with pytest.raises(ValueError):
            url_filter.judge(pages, strict=bad)


def test_url_hits_count_once_between_boundaries():
    row, term = url_filter.distinct_hits(["spam spam", "xspam", "", "win", "a.win/spam"], ("spam", "win"))
    assert list(zip(row.tolist(), term.tolist())) == [(0, 0), (3, 1), (4, 0), (4, 1)]


# ------------------------------------------------------------------ conversations


def repaired(rows):
    """(cost, audit, lines) of rows (role, text, fault) by trying all edits, at most two insertions before each row and at the end."""
    best = None
    ins = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    form = re.compile("(s?(ua)+)?")

    def walk(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for before in ins:
            c, a, out = cost + 2 * len(before), audit + "I" * len(before), lines + [(r, "") for r in before]
            if i == len(rows):
                if form.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, [f"{r}:{t}" for r, t in out])
                continue
            role, text, fault = rows[i]
            walk(i + 1, c + 3, a + "D", out)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                walk(i + 1, c + more, a + "K", out + [(role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, c + 2 + more, a + "R", out + [(new, text)])

    walk(0, 0, "", [])
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def expected(rows):
    turns = [t for t, *_ in rows if t is not None]
    listed = faults([(r, x) for _, r, x in rows])
    cost, audit, lines = repaired(listed)
    count = lambda kind: sum(f == kind for *_, f in listed)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in itertools.pairwise(listed))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(0, 5)):
            turn = rng.choice([turn, turn, turn, None, turn + 3])
            role, text = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ultra"]), rng.choice(["Yes.", "No!", "Why?", "so", "", " \t", "x. ", "é。"])
            out += [(conv if conv else None, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return out


@pytest.mark.parametrize("block_rows", [65_536, 2])
def test_repair_equals_all_edits(spark, block_rows):
    rows = conversations(3, 60)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, seq int").repartition(4)
    edits = conversation_repair.repair(turns, block_rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.digests(edits, turns).collect()}
    held = {}
    for conv, *rest in rows:
        held.setdefault(conv, []).append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert got == {c: expected(sorted(r, key=order)) for c, r in held.items()}


def test_repair_of_one_hot_conversation(spark):
    """Ranges of one conversation give what one search over all of it gives; a row that stands there a million times is one row."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randint(0, 400)}{rng.choice(['.', '', '?'])}", 1) for t in range(900)] + [(7, 5, "user", "Again.", 1_000_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, times long").repartition(3)
    whole, cut = (conversation_repair.digests(conversation_repair.repair(turns, n), turns).first() for n in (10_000, 60))
    assert whole == cut and whole["duplicate"] >= 999_999 and len(whole["audit"]) >= 1_000_900


def test_search_forgets_what_is_settled():
    """On a clean conversation survivors coalesce at once; edits held stay few however long it is."""
    search, most, settled = conversation_repair.Search(), 0, 0
    for i in range(20_000):
        settled += len(search.take(i, "ua"[i % 2], False, False))
        node, deep = max(search.live.values(), key=lambda x: x[0])[2], 0
        while node is not search.root:
            node, deep = node.parent, deep + 1
        most = max(most, deep)
    assert most <= 8 and settled >= 20_000 - 8


def test_repair_of_damage_and_nulls(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (None, None, "user", "Hi."), (2, 3, "user", "Hi."), (2, 4, "assistant", "Ho."), (2, 4, "assistant", "Ho.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.digests(conversation_repair.repair(turns), turns).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["blank"], r["duplicate"], r["audit"]) for r in got] == [(None, 0, 0, "KI"), (1, 2, 0, "DD"), (2, 0, 1, "KKD")]
    empty = turns.limit(0)
    assert conversation_repair.digests(conversation_repair.repair(empty), empty).count() == 0
    gone = conversation_repair.repair(turns.withColumn("times", F.lit(0)))
    left = conversation_repair.digests(gone, turns).where("conv_id = 2").first()
    assert tuple(left)[1:7] == (0,) * 6 and left["audit"] == "" and left["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    hurt = {(r["conv_id"], r["turn"]): r for r in queries.damaged(turns).collect()}
    assert hurt[(1, None)]["role"] in (" ", "user") and all(r["text"] is not None for r in hurt.values())


# ------------------------------------------------------------------ hard negatives


def mined(rows, scale=256):
    good = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(scale * float(x))) for x in v]) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({g[0] for g in good if g[0] % 100 == 0}):
        _, label, va = min(g for g in good if g[0] == a)
        score = [(-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in good if i != a and len(v) == len(va)]
        for place, (ps, p, _) in enumerate(sorted(s for s in score if s[2] == label)[:5]):
            fit = sorted((s, i) for s, i, l in score if l != label and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(a, p, rank + 1, i, -ps, -s) for rank, (s, i) in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, part string").repartition(3)


def mine(spark, rows, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, label, **more).collect())


@pytest.mark.parametrize("more", [{}, {"part_rows": 40, "query_rows": 2}])
def test_hard_negatives(spark, more):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 6))
    rows = [(i, (centre[i % 4] + rng.normal(size=6) * 0.6).round(1).tolist(), int(rng.integers(0, 3))) for i in range(420)]
    rows += [(i + 500, r[1], r[2]) for i, r in enumerate(rows[:20])] + [(300, rows[1][1], 1), (700, [0.0] * 6, 1), (701, None, 1), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (900, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(901, [1.0] * 6, None), (None, [1.0] * 6, 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [0.5, 1.0], 2), (1100, [], 1), (1200, [float("inf")] * 6, 1)]
    want = mined(rows)
    assert len(want) > 100 and mine(spark, rows, **more) == want


def test_hard_negatives_of_huge_numbers_and_no_rows(spark):
    rows = [(i, [float(10**6 + i * 7) + 0.37, float(i % 70) * 1e4], i // 10 % 2) for i in range(0, 300, 10)]
    assert len(mined(rows)) > 20 and mine(spark, rows) == mined(rows)
    assert hard_negatives.mine(vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_tree_prunes_clusters_and_loses_nothing():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(50, 8)) * 200
    items = np.floor(centre[rng.integers(0, 50, 6000)] + rng.normal(size=(6000, 8)) * 8)
    ids, queries_ = rng.permutation(6000), items[:20] + 3
    windows = [([s * 0.3, -np.inf], [s * 0.9, np.inf]) for s in (items @ queries_.T).max(axis=0)]
    found, share = hard_negatives.within(np.full(20, -1), queries_, windows, ids, items, 10, False)
    got = {(q, w): (i.tolist(), s.tolist()) for q, w, i, s in found}
    for q, (low, high) in enumerate(windows):
        score = items @ queries_[q]
        for w in range(2):
            fit = np.flatnonzero((score >= low[w]) & (score <= high[w]))
            first = fit[np.lexsort((ids[fit], -score[fit]))[:10]]
            assert got[q, w] == (ids[first].tolist(), score[first].tolist())
    assert share < 0.6
