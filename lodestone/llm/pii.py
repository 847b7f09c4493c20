"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find. Beside them, words can
give an entity away. Over all texts, with N distinct texts, n(e) of them with entity e, n(t) with word t, and n(e, t) with t
near e, the pointwise mutual information of t and e is log2(N n(e,t) / (n(e) n(t))), and e's whole information is
log2(N / n(e)). A word whose share of that reaches a threshold discloses e: it is generalised, or removed above a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values. Kinds in order, each with a cheap test and its pattern. Runs that nothing can split are matched possessively,
#: and a match begins where a run does (or where the last match ended), so a text is read in linear time.
KINDS = ("email", "ip", "card", "phone")
_TESTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][0-9 -]{12}", "phone": r"\+[0-9]"}
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_EDGE = r"(?<![\p{L}\p{N}_])"
WORD = _EDGE + r"\p{L}[\p{L}\p{N}_]{3,}+"


def _none() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT, value: STRING>>)")


def find(text: Column, pattern: Column) -> Column:
    """array<struct<start, stop, value>>: all matches from left to right, in code points."""
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("value"))
    first = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + F.coalesce(step["gap"], F.lit(0))
        stop = start + F.length(step["value"])
        more = F.array_append(state["found"], F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), step["value"].alias("value")))
        return F.struct(F.coalesce(stop, start).cast("int").alias("at"), F.when(step["value"].isNull(), state["found"]).otherwise(more).alias("found"))

    return F.aggregate(steps, first, add)["found"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if a number's check digit is right."""
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; failing ones are dropped without another try."""
    may = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_TESTS[kind])
    return F.when(may, F.filter(find(text, F.lit(_PATTERNS[kind])), lambda m: _VALID[kind](m["value"]))).otherwise(_none())


def _ordered(spans: Column) -> Column:
    """kind:start:stop, comma-joined, by start and then by kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _kinded(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _valued(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))


def generalised(word: Column) -> Column:
    """The class that a word is generalised to."""
    return F.when(word.rlike(r"\p{N}"), "<code>").when(word.rlike(r"^\p{Lu}+$"), "<acronym>").when(word.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 60, support: int = 3, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """One row per row of docs: row (the input row as a struct), base (spans of each kind), terms, spans, clean_text.

    A word of four characters or more discloses an entity if it stands within `near` code points of it in at least `support`
    distinct texts and its share of the entity's information reaches `generalise`; it then counts wherever it stands. In
    clean_text a protected entity becomes its kind in angle brackets; a disclosing word is generalised to its class (<code>
    with a digit, <acronym> all in capitals, <name> with a capital first, <word> otherwise), or goes from `remove` on.
    Copies of a text count once, near copies each. Null texts count as empty; ids may be null or repeat (texts are known by
    their hash); other columns are carried along whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("row", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    own = texts.select("h1", "h2", "text")
    based = own.select("h1", "h2", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    spans = F.concat(*[_valued(k) for k in KINDS])
    hits = based.select("h1", "h2", "text", spans.alias("base")).where(F.size("base") > 0)

    # words near an entity
    def around(s: Column) -> Column:
        left = F.greatest(s["start"] - near, F.lit(0))
        before = F.substr(F.col("text"), left + 1, s["start"] - left)
        after = F.substr(F.col("text"), s["stop"] + 1, F.lit(near))
        cut = F.when(left > 0, F.regexp_replace(before, r"^[^\x20\x09-\x0D]+", "")).otherwise(before)
        tail = F.when(F.length(after) == near, F.regexp_replace(after, r"[^\x20\x09-\x0D]+$", "")).otherwise(after)
        return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(cut), F.lit(WORD), 0), F.regexp_extract_all(F.lower(tail), F.lit(WORD), 0)))

    about = F.transform("base", lambda s: F.struct(F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))).alias("entity"), around(s).alias("words")))
    near_by = common.saved(hits.select("h1", "h2", F.inline(about)), "near")
    copies = common.saved(own.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    once = own.join(common.small_side(copies, copies.count()), ["h1", "h2"], "left").withColumn("part", 1 / F.coalesce("copies", F.lit(1)))
    total = once.agg(F.round(F.sum("part"))).head()[0] or 0  # distinct texts: a copy counts as its part of the text that it repeats
    whole = F.log2(F.lit(float(max(total, 2))) / F.col("n_entity"))

    # a share of g asks for n(t) <= n(e, t) (N / n(e)) ** (1 - g), and n(t) is at least the number of texts that have t near
    # any entity at all: pairs beyond that can't disclose, whatever n(t) is, and their words need no counting
    entities = near_by.select("h1", "h2", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    beside = near_by.select("h1", "h2", "entity", F.explode("words").alias("word")).distinct()
    pairs = beside.groupBy("entity", "word").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    near_any = beside.select("h1", "h2", "word").distinct().groupBy("word").agg(F.count("*").alias("near_any"))
    most = F.col("both") * F.pow(F.lit(2.0), (1 - generalise) * whole) * (1 + 1e-9)
    pairs = pairs.join(entities, "entity").where(whole > 0).join(near_any, "word").where(F.col("near_any") <= most).select("entity", "word", "both", "n_entity")
    pairs = common.saved(pairs, "pairs")

    # how many texts hold each word that is left
    wanted = common.saved(pairs.select("word").distinct(), "wanted")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))).alias("word")
    n_word = once.select("part", words).join(common.small_side(wanted, wanted.count()), "word", "left_semi").groupBy("word").agg(F.round(F.sum("part")).alias("n_word"))
    share = 1 - F.log2(F.greatest("n_word", "both") / F.col("both")) / whole
    disclosing = pairs.join(n_word, "word").groupBy("word").agg(F.max(share).alias("share")).where(F.col("share") >= generalise)
    disclosing = common.saved(disclosing, "disclosing")
    holds = own.select("h1", "h2", words).join(common.small_side(disclosing, disclosing.count()), "word").distinct()
    marked = common.saved(holds.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("word", "share"))).alias("shares")), "marked")

    out = texts.join(common.small_side(marked, marked.count(), 100_000), ["h1", "h2"], "left")
    out = out.select("row", "text", "shares", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    out = out.withColumn("base", F.array_sort(F.concat(*[_kinded(F.col(k), k, i) for i, k in enumerate(KINDS)])))
    theirs = F.concat(F.lit(f"(?iu){_EDGE}(?:"), F.array_join(F.map_keys("shares"), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    terms = F.transform(F.filter(find(F.col("text"), theirs), lambda s: F.map_contains_key("shares", F.lower(s["value"]))), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["stop"].alias("stop"), F.when(F.element_at("shares", F.lower(s["value"])) >= remove, "removed").otherwise("term").alias("kind")))
    free = F.filter(terms, lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    out = out.withColumn("terms", F.when(F.col("shares").isNull(), F.filter("base", lambda b: F.lit(False))).otherwise(free))

    def add(state: Column, s: Column) -> Column:
        own = F.substr(F.col("text"), s["start"] + 1, s["stop"] - s["start"])
        shown = F.when(s["kind"] == "removed", "").when(s["kind"] == "term", generalised(own)).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        new = F.array_append(state["parts"], F.concat(F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"]), shown))
        ahead = s["start"] >= state["at"]
        return F.struct(F.when(ahead, s["stop"]).otherwise(F.greatest(state["at"], s["stop"])).alias("at"), F.when(ahead, new).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("parts"))
    all_spans = F.array_sort(F.concat("base", "terms"))
    built = F.aggregate(all_spans, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(F.col("text"), s["at"] + 1, F.length("text"))))
    some = (F.size("base") > 0) | (F.size("terms") > 0)
    return out.select("row", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size("terms").cast("long").alias("n_term"), _ordered(F.col("base")).alias("base"), _ordered(all_spans).alias("spans"), F.when(some, built).otherwise(F.col("text")).alias("clean_text"))
