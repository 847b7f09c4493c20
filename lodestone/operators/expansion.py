"""Evidence finer than chunks: sentences, table rows and quotes of the chunks around a question's anchors, and of their documents.

Chunks are doc_id, chunk_no, text, page_start, page_end, section, chunk_type; pages that are null or 0 are unknown. What is made of a
chunk is made within its row; only what scores well enough is shuffled, and a hot document's rows are cut to its quota before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, quotes
from ..functions import text as T
from ..sources.scratch import saved
from .chunking import computed
from .fuse import distinct_text
from .search import small

#: Anchors of a question, chunks around each, units of a chunk, the scores that units must have, the share of local ones.
ANCHORS, PLACES, UNITS = 12, 10, 4
LOCAL_LEAST, DOCUMENT_LEAST, MECHANISM_LEAST, LOCAL_SHARE = 0.58, 0.78, 0.14, 0.65
QUOTES = (360, 420)
#: How far a chunk of the same section may be, and the width of the buckets that neighbours are joined by.
REACH, BUCKET, PAGES = 6, 7, 4
#: What a kind of unit is worth in a document, and in the final order.
IN_DOCUMENT = {"table_row": 0.03, "phrase": 0.02, "sentence": 0.01}
GRANULARITY = {"table_row": 0.035, "phrase": 0.03, "sentence": 0.02}


def _worth(kind: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in table.items()], F.lit(0.0))


def asked(questions: DataFrame) -> DataFrame:
    """(qid, question, keywords, phrases, terms, numeric, mechanism) of questions (qid, question): all that units are scored by."""
    question, low = T.whole(F.col("question")), F.lower(F.col("question"))
    numeric = T.contains_any(low, fixed.ASKS["metric"]) | low.rlike(r"(?U)\b(?:" + "|".join(fixed.ASKS["efficiency"]) + r")\b")
    mechanism = T.contains_any(F.lower(T.sanitize(F.col("question"))), fixed.ASKS["mechanism"])
    named = computed(questions.select("qid", question.alias("question")), keywords=T.question_keywords(F.col("question")), phrases=T.question_phrases(F.col("question")), numeric=numeric, mechanism=mechanism)
    return computed(named, terms=quotes.needles(quotes.focus_terms(F.col("question"), F.col("keywords"), F.col("phrases"))))


def support(unit: Column, kind: str) -> Column:
    """How well a unit answers the question of its row, before what its place adds: the score is that sum, cut to 1."""
    low = F.lower(T.whole(unit))
    number = F.when(low.rlike(quotes.UNIT_NUMBER), F.when(F.col("numeric"), 0.24).otherwise(0.1)).otherwise(0.0)
    words = F.size(F.filter(F.slice("keywords", 1, 18), lambda w: F.contains(low, F.lower(w))))
    phrases = F.size(F.filter(F.slice("phrases", 1, 8), lambda p: F.contains(low, p)))
    mechanism = F.when(F.col("mechanism"), quotes.mechanism_bonus(low)).otherwise(0.0)
    relevance = T.relevance(F.col("question"), F.col("keywords"), F.col("phrases"), low)
    return F.round(0.42 + relevance * 0.55 + F.least(words, F.lit(5)) * 0.035 + F.least(phrases, F.lit(3)) * 0.08 + number + {"phrase": 0.12, "sentence": 0.08}[kind] + mechanism, 9)


def row_units(rows: DataFrame) -> DataFrame:
    """rows of a chunk and a question (columns of `asked`) with `units`: array of struct<kind_no, kind, nth, unit_no, unit, raw>.

    The three best table rows (.58, .08 for each term and for each of four numbers, .07 for each metric word), the five best sentences
    (24 characters or more; one under 90 takes the next along), and the quote: of 360 characters as kind_no 2, unless it is the whole
    text, and of 420 as kind_no 3.
    """
    rows = computed(rows.withColumn("_clean", T.sanitize(F.col("text"))), _parts=quotes.sentences(F.col("_clean")), _tabular=T.is_table(F.col("_clean")))
    tabled = F.col("_tabular") | F.contains(F.lower(T.whole(F.col("chunk_type"))), F.lit("table"))
    rows = computed(rows, _rows=F.when(tabled, quotes.table_rows(F.col("_clean"))).otherwise(T.empty()))
    rows = computed(rows, _header=quotes.table_header(F.col("_rows")))
    told = quotes.quote(F.col("_clean"), F.col("_parts"), F.col("_rows"), F.col("_header"), F.col("_tabular"), F.col("terms"), QUOTES)
    n, next_ = F.size("_parts"), lambda i: F.get(F.col("_parts"), i + 1)
    paired = F.filter(F.transform("_parts", lambda s, i: F.struct(i.alias("unit_no"), F.when((F.length(s) < 90) & (i + 1 < n), F.concat(s, F.lit(" "), next_(i))).otherwise(s).alias("unit"), (F.length(s) >= 24).alias("long"))), lambda x: x["long"])
    rows = computed(rows, _quotes=told, _paired=paired)

    def table_unit(r: Column, i: Column) -> Column:
        low = F.lower(r)
        hits, numbers, metrics = quotes.met(F.col("terms"), quotes.haystack(low)), T.count(low, quotes.UNIT_NUMBER), T.hits(low, fixed.ROW_METRICS)
        score = F.round(F.least(F.lit(1.0), 0.58 + hits * 0.08 + F.least(numbers, F.lit(4)) * 0.08 + metrics * 0.07), 9)
        speaks = (r != F.col("_header")) & ((hits > 0) | (numbers > 0) | (metrics > 0))
        told = F.when((F.length("_header") > 0) & ~F.contains(r, F.col("_header")), F.concat(F.col("_header"), F.lit(" | "), r)).otherwise(r)
        return F.when(speaks, F.struct((-score).alias("minus"), i.alias("unit_no"), told.alias("unit")))

    def unit(kind_no: Column, kind: str, nth: Column, unit_no: Column, text: Column, raw: Column) -> Column:
        return F.struct(kind_no.cast("int").alias("kind_no"), F.lit(kind).alias("kind"), nth.cast("int").alias("nth"), unit_no.cast("int").alias("unit_no"), text.alias("unit"), raw.cast("double").alias("raw"))

    def best(items: Column, kind_no: int, kind: str, most: int, cut: int) -> Column:
        return F.transform(F.slice(F.array_sort(items), 1, most), lambda x, i: unit(F.lit(kind_no), kind, i, x["unit_no"], T.truncate(x["unit"], cut), -x["minus"]))

    scored = F.transform("_paired", lambda x: F.struct((-F.least(F.lit(1.0), support(x["unit"], "sentence"))).alias("minus"), x["unit_no"].alias("unit_no"), x["unit"].alias("unit")))
    section = F.when(T.contains_any(F.lower(T.whole(F.col("section"))), fixed.UNIT_SECTIONS), 0.06).otherwise(0.0)
    quoted = F.transform("_quotes", lambda x, i: unit(i + 2, "phrase", F.lit(0), F.lit(90), x, F.round(support(x, "phrase") + section, 9)))
    quoted = F.filter(quoted, lambda x: (F.length(x["unit"]) > 0) & ((x["kind_no"] == 3) | (x["unit"] != T.truncate(F.col("_clean"), QUOTES[0]))))
    units = F.concat(best(F.array_compact(F.transform("_rows", table_unit)), 0, "table_row", 3, 620), best(scored, 1, "sentence", 5, 520), quoted)
    return computed(rows, ("_clean", "_parts", "_tabular", "_rows", "_header", "_quotes", "_paired"), units=units)


def places(anchors: DataFrame, chunks: DataFrame, most: int = PLACES) -> DataFrame:
    """(qid, anchor_no, anchor_score, doc_id, chunk_no, place, bonus): the chunks nearest to each anchor that a rule admits.

    anchors: qid, anchor_no, anchor_score, doc_id, chunk_no, page_start, page_end, section. Fixed values: .18 for the chunk itself, .12
    and .08 for those one and two away, .09 on one of its pages, .07 in its section within six; the largest counts. Neighbours meet
    in buckets of chunk numbers and of pages, so a long document isn't compared with all its anchors.
    """
    page = lambda name: F.nullif(F.col(name), F.lit(0))
    own = [F.col(c) for c in ("qid", "anchor_no", "anchor_score", "doc_id")] + [F.col("chunk_no").alias("at")]
    a = anchors.select(*own, page("page_start").alias("from"), F.coalesce(page("page_end"), page("page_start")).alias("to"), F.lower(F.trim(F.col("section"))).alias("in"))
    c = chunks.select("doc_id", "chunk_no", page("page_start").alias("first"), F.coalesce(page("page_end"), page("page_start")).alias("last"), F.lower(F.trim(F.col("section"))).alias("named"))
    bucket = lambda x, width: F.floor(x / width)
    near_a = a.withColumn("b", F.explode(F.sequence(bucket(F.col("at") - REACH, BUCKET), bucket(F.col("at") + REACH, BUCKET))))
    near = c.withColumn("b", bucket(F.col("chunk_no"), BUCKET)).join(small(near_a), ["doc_id", "b"]).where(F.abs(F.col("chunk_no") - F.col("at")) <= REACH)
    paged_a = a.where("from <= to").withColumn("b", F.explode(F.sequence(bucket(F.col("from"), PAGES), bucket(F.col("to"), PAGES))))
    paged_c = c.where("first <= last").withColumn("b", F.explode(F.sequence(bucket(F.col("first"), PAGES), bucket(F.col("last"), PAGES))))
    paged = paged_c.join(small(paged_a), ["doc_id", "b"]).where("from <= last and first <= to")
    gap = F.abs(F.col("chunk_no") - F.col("at"))
    shared = F.coalesce((F.col("from") <= F.col("last")) & (F.col("first") <= F.col("to")), F.lit(False))
    same = F.coalesce((F.length("in") > 0) & (F.col("in") == F.col("named")), F.lit(False))
    bonus = F.when(gap == 0, 0.18).when(gap == 1, 0.12).when(shared, 0.09).when(gap == 2, 0.08).when(same & (gap <= REACH), 0.07)
    pairs = near.drop("b").unionByName(paged.drop("b")).withColumn("gap", gap).withColumn("bonus", bonus).where("bonus is not null")
    once = pairs.groupBy("qid", "anchor_no", "doc_id", "chunk_no").agg(F.max("anchor_score").alias("anchor_score"), F.min("gap").alias("gap"), F.max("bonus").alias("bonus"))
    order = Window.partitionBy("qid", "anchor_no").orderBy("gap", F.desc("bonus"), "chunk_no")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("gap")


def scored_units(rows: DataFrame) -> DataFrame:
    """rows with `units` (of `row_units`) and `near` (array of struct<anchor_no, place, anchor_score, bonus>, or null) with what of them
    is good enough: `local` (anchor_no, place, nth, kind, unit_no, score, text, key) and `far` (priority, kind, unit_no, score, text, key).

    Local: four sentences at most, rows and sentences raised by .18 of the anchor's score and by what the place adds, the quote by .28
    of it; of equal texts of a chunk the best stays; the best four of .58 or more. Far: all of .78 or more or with a mechanism's words
    for .14, pictures left out; for questions on a mechanism its words come before the score.
    """
    one = F.lit(1.0)

    def placed(a: Column) -> Column:
        anchor = F.least(F.coalesce(a["anchor_score"], F.lit(0.0)), one)

        def raised(x: Column) -> Column:
            score = F.round(F.least(one, x["raw"] + anchor * F.when(x["kind"] == "phrase", 0.28).otherwise(0.18) + a["bonus"]), 9)
            first = F.when(x["kind"] == "phrase", score).otherwise(x["raw"])
            return F.struct((-first).alias("minus"), x["unit_no"].alias("unit_no"), x["kind_no"].alias("kind_no"), x["kind"].alias("kind"), score.alias("score"), x["unit"].alias("text"), distinct_text(x["unit"]).alias("key"))

        own = F.filter("units", lambda x: (x["kind_no"] < 3) & ((x["kind_no"] != 1) | (x["nth"] < 4)))
        fresh = quotes.let(F.array_sort(F.transform(own, raised)), lambda u: F.filter(u, lambda x, i: (F.length(x["key"]) > 0) & (x["score"] >= LOCAL_LEAST) & ~F.exists(F.slice(u, F.lit(1), i), lambda y: y["key"] == x["key"])))
        return F.transform(F.slice(fresh, 1, UNITS), lambda x, i: F.struct(a["anchor_no"].alias("anchor_no"), a["place"].alias("place"), i.alias("nth"), *[x[c].alias(c) for c in ("kind", "unit_no", "score", "text", "key")]))

    def far(x: Column) -> Column:
        words = F.when(F.col("mechanism"), quotes.mechanism_bonus(F.lower(x["unit"]))).otherwise(0.0)
        score = F.round(F.least(one, F.least(one, x["raw"]) + words * 0.45 + 0.04), 9)
        return F.struct(F.when(F.col("mechanism"), words).otherwise(score).alias("priority"), words.alias("words"), x["kind"].alias("kind"), x["unit_no"].alias("unit_no"), score.alias("score"), x["unit"].alias("text"), distinct_text(x["unit"]).alias("key"))

    drawn = F.contains(F.lower(T.whole(F.col("chunk_type"))), F.lit("image"))
    given = F.when(drawn, F.slice("units", 1, 0)).otherwise(F.filter("units", lambda x: x["kind_no"] != 2))
    good = F.filter(F.transform(given, far), lambda x: (F.length(x["key"]) > 0) & ((x["score"] >= DOCUMENT_LEAST) | (x["words"] >= MECHANISM_LEAST)))
    return computed(rows, ("units", "near"), local=F.flatten(F.transform("near", placed)), far=good)


def expand(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """(qid, rank, doc_id, chunk_no, kind, unit_no, score, expanded_from, text): candidates and finer units of their surroundings.

    candidates (qid, rank, doc_id, chunk_no, score) are chunks, ranked from 1; the first twelve that aren't pictures are anchors. Units of
    the chunks near them fill the limit up to .65 of it, in the order of anchors, distance and score; then units of the anchors'
    documents follow, document by document, 2 to 6 of each by what room there is, one of a chunk. Texts of 260 characters that are equal
    but for case and spaces count once: a candidate's, else the first local one, else the best of a document (if that isn't chosen
    because its chunk has a better one, no copy takes its place). All are ordered by score, fineness and position.
    A question has at least as many rows as candidates. Questions without candidates have no rows; null ids don't take part.
    """
    q = saved(asked(questions.where("qid is not null")), "asked")
    shown = candidates.where("doc_id is not null").join(chunks, ["doc_id", "chunk_no"]).select("qid", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"), "text", "page_start", "page_end", "section", "chunk_type")
    shown = saved(shown.withColumn("key", distinct_text(T.sanitize(F.col("text")))), "shown")
    room = shown.groupBy("qid").agg(F.count("*").alias("had")).withColumn("limit", F.greatest(F.lit(limit), F.col("had")))
    room = room.withColumn("local", F.least("limit", F.greatest(F.col("had"), F.floor(F.col("limit") * LOCAL_SHARE))) - F.col("had"))
    drawn = T.contains_any(F.lower(T.whole(F.col("chunk_type"))), ["image", "figure", "chart"])
    ranked = shown.withColumn("anchor_no", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id", "chunk_no"))).where((F.col("anchor_no") <= ANCHORS) & ~drawn)
    anchors = saved(ranked.select("qid", "anchor_no", F.col("score").alias("anchor_score"), "doc_id", "chunk_no", "page_start", "page_end", "section"), "anchors")

    scope = anchors.groupBy("qid", "doc_id").agg(F.min("anchor_no").alias("first"))
    scope = saved(scope.withColumn("doc_no", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first"), "scope")
    near = places(anchors, chunks).groupBy("qid", "doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("anchor_no", "place", "anchor_score", "bonus"))).alias("near"))
    rows = chunks.select("doc_id", "chunk_no", "text", "section", "chunk_type").join(small(scope), "doc_id").join(small(near), ["qid", "doc_id", "chunk_no"], "left").join(small(q), "qid")
    found = scored_units(row_units(rows)).select("qid", "doc_no", "doc_id", "chunk_no", "local", "far")
    found = saved(found.where("size(local) > 0 or size(far) > 0"), "units")

    seen = shown.select("qid", "key").distinct()
    around = found.select("qid", "doc_id", "chunk_no", F.inline("local")).join(seen, ["qid", "key"], "left_anti")
    first = F.struct("anchor_no", "place", "nth")
    local = around.groupBy("qid", "key").agg(F.min(first).alias("at"), F.min_by(F.struct("doc_id", "chunk_no", "kind", "unit_no", "score", "text"), first).alias("u"))
    local = local.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).join(room, "qid").where(F.col("n") <= F.col("local"))
    local = saved(local.select("qid", "key", "n", "u.*"), "local")

    taken = local.groupBy("qid").agg(F.count("*").alias("n_local"))
    docs = scope.groupBy("qid").agg(F.count("*").alias("docs"))
    left = room.join(docs, "qid").join(taken, "qid", "left").withColumn("left", F.col("limit") - F.col("had") - F.coalesce("n_local", F.lit(0))).where("left > 0")
    left = left.select("qid", "left", F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.col("left") / F.col("docs")) + 2)).alias("cap"))
    every = found.select("qid", "doc_no", "doc_id", "chunk_no", F.inline("far")).join(seen.unionByName(local.select("qid", "key")), ["qid", "key"], "left_anti")
    best = F.struct("doc_no", (-F.col("priority")).alias("p"), (-F.col("score")).alias("s"), (-_worth(F.col("kind"), IN_DOCUMENT)).alias("k"), "chunk_no", "unit_no")
    unit = F.struct("doc_id", "kind", "score", "text")
    once = every.groupBy("qid", "key").agg(F.min(best).alias("at"), F.min_by(unit, best).alias("u"))
    once = once.groupBy("qid", "u.doc_id", "at.chunk_no").agg(F.min("at").alias("at"), F.min_by("u", "at").alias("u"))
    quota = once.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("at"))).where("nth <= 6").join(left, "qid").where(F.col("nth") <= F.col("cap"))
    quota = quota.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at.doc_no", "nth"))).where(F.col("n") <= F.col("left"))

    def rows(df: DataFrame, phase: int, source: str, kind: Column, unit_no: Column, n: str, *cells: str) -> DataFrame:
        return df.select("qid", F.lit(phase).alias("phase"), F.col(n).cast("long").alias("n"), F.col("doc_id"), F.col(cells[0]).alias("chunk_no"), kind.alias("kind"), unit_no.cast("int").alias("unit_no"), F.col(cells[1]).alias("score"), F.lit(source).alias("expanded_from"), F.col(cells[2]).alias("text"))

    out = rows(shown, 0, "", F.lit("chunk"), F.lit(None), "rank", "chunk_no", "score", "text")
    out = out.unionByName(rows(local, 1, "neighbour", F.col("kind"), F.col("unit_no"), "n", "chunk_no", "score", "text"))
    out = out.unionByName(rows(quota, 2, "document", F.col("u.kind"), F.col("at.unit_no"), "n", "chunk_no", "u.score", "u.text"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(_worth(F.col("kind"), GRANULARITY)), "phase", "n", "doc_id", "chunk_no")
    return out.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "doc_id", "chunk_no", "kind", "unit_no", "score", "expanded_from", "text")
