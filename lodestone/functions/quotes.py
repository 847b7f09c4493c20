"""The sentences and table rows of a text that speak to a question, as native column expressions.

Texts here are sanitised already; a null text has no sentences and no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T

#: Marks before and after each word, so that a term that must be a whole word is looked for as plain text.
BEGIN, END = "\x01", "\x02"
#: Numbers as quotes and units count them, with the measures that may follow.
QUOTED_NUMBER = r"(?U)\b\d+(?:\.\d+)?\s*(?:%|m|b|k|million|billion)?\b"
UNIT_NUMBER = r"(?U)\b\d+(?:\.\d+)?\s*(?:%|x|times|m|b|k|million|billion)?\b"


def let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


def marked(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w+)", f"{BEGIN}$1{END}")


def focus_terms(question: Column, keywords: Column, phrases: Column, extra: Column | None = None) -> Column:
    """Terms that a quote is chosen by, first met first, 32 at most: keywords, extra ones (of roles, say), eight phrases, plain words."""
    words = F.regexp_extract_all(F.lower(T.whole(question)), F.lit(rf"[a-z0-9][a-z0-9\-]{{1,}}|[{T.CJK}]{{2,}}"), 0)
    every = F.concat(keywords, T.empty() if extra is None else extra, F.slice(phrases, 1, 8), words)
    kept = F.filter(F.transform(every, lambda t: F.lower(T.strip(t))), lambda t: (F.length(t) >= 2) & ~t.isin(fixed.QUOTE_STOP))
    return F.slice(F.array_distinct(kept), 1, 32)


def needles(terms: Column) -> Column:
    """Terms as they are looked for in a `haystack`: plain words between marks (after a last hyphen a word must follow), others as they are."""
    return F.transform(terms, lambda t: F.when(t.rlike(r"^[a-z0-9][a-z0-9\-]*$"), F.concat(marked(t), F.when(t.endswith("-"), BEGIN).otherwise(""))).otherwise(t))


def haystack(low: Column) -> Column:
    return F.concat(low, F.lit("\n"), marked(low))


def met(found: Column, hay: Column) -> Column:
    """How many needles a haystack has."""
    return F.size(F.filter(found, lambda t: F.contains(hay, t)))


def sentences(clean: Column) -> Column:
    """Quotable sentences of eight characters or more, no table rows; one over 420 is cut after its commas."""
    parts = F.transform(F.split(T.whole(clean), r"(?U)\n+|(?<=[.!?。！？；;])\s+"), T.squeeze)
    pieces = lambda p: F.filter(F.transform(F.split(p, r"(?U)(?<=[,，;；])\s+"), T.strip), lambda s: F.length(s) >= 20)
    cut = F.flatten(F.transform(parts, lambda p: F.when((F.length(p) > 420) & p.rlike("[,，;；]"), pieces(p)).otherwise(F.array(p))))
    return F.filter(cut, lambda s: (F.length(s) >= 8) & ~T.is_table(s))


def table_rows(clean: Column) -> Column:
    """Rows of a table, cells joined by ' | ', without rulers. A table of one line is cut where a number meets a name with a number."""
    kept = F.filter(F.transform(T.lines(clean), T.squeeze), lambda x: ~x.rlike(r"^[:|\-\s]+$"))
    cells = lambda x: F.array_join(F.filter(F.transform(F.split(x, r"\|"), T.strip), lambda c: F.length(c) > 0), " | ")
    rows = F.filter(F.transform(kept, lambda x: F.when(F.contains(x, F.lit("|")), cells(x)).otherwise(x)), lambda r: F.length(r) > 0)
    flat = F.filter(F.split(T.squeeze(clean), r"(?<=\d)\s+(?=[A-Z][A-Za-z0-9 /-]{2,}\s+\d)"), lambda r: F.length(r) > 0)
    return let(rows, lambda r: F.when(F.size(r) <= 1, flat).otherwise(r))


def table_header(rows: Column) -> Column:
    """The first of three rows that names a metric, a model or the like and has fewer than four digits; empty if none does."""
    heads = F.filter(F.slice(rows, 1, 3), lambda r: T.contains_any(F.lower(r), fixed.HEADER_WORDS) & (T.count(r, r"\d") < 4))
    return F.coalesce(F.get(heads, F.lit(0)), F.lit(""))


def _by_score(items: Column) -> Column:
    """Structs (score, n, text), best first, ties to the earlier."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct((-x["score"]).alias("minus"), x["n"].alias("n"), x["text"].alias("text")))), lambda x: F.struct((-x["minus"]).alias("score"), x["n"].alias("n"), x["text"].alias("text")))


def _in_order(items: Column) -> Column:
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["n"], x["text"]))), lambda x: x["text"])


def sentence_quote(parts: Column, terms: Column) -> Column:
    """The two sentences with most of the needles `terms`, .35 for a number and .2 for words of method, in text order; null if none scores."""
    score = lambda low: met(terms, haystack(low)) + F.when(low.rlike(QUOTED_NUMBER), 0.35).otherwise(0.0) + F.when(T.contains_any(low, fixed.QUOTE_METHOD), 0.2).otherwise(0.0)
    scored = F.filter(F.transform(parts, lambda s, i: F.struct(score(F.lower(s)).cast("double").alias("score"), i.alias("n"), s.alias("text"))), lambda x: x["score"] > 0)
    return let(F.slice(_by_score(scored), 1, 2), lambda best: F.when(F.size(best) > 0, F.array_join(_in_order(best), " ")))


def table_quote(rows: Column, header: Column, terms: Column) -> Column:
    """The header and the best row, or two that are within .2 of each other: needles met, .35 for each of three numbers, .45 for each
    metric word; where no row has any, those with most digits. Null without rows."""
    low_score = lambda low: met(terms, haystack(low)) + F.least(F.lit(3), T.count(low, QUOTED_NUMBER)) * 0.35 + T.hits(low, fixed.QUOTE_METRICS) * 0.45
    plain = lambda r: T.count(r, r"(?U)\d") * 0.05 + F.when(F.contains(r, F.lit("|")), 0.2).otherwise(0.0)
    own = F.filter(F.transform(rows, lambda r, i: F.struct(F.round(low_score(F.lower(r)).cast("double"), 6).alias("score"), i.alias("n"), r.alias("text"))), lambda x: x["text"] != header)
    other = F.filter(F.transform(rows, lambda r, i: F.struct(F.round(plain(r).cast("double"), 6).alias("score"), i.alias("n"), r.alias("text"))), lambda x: x["text"] != header)
    scored = let(F.filter(own, lambda x: x["score"] > 0), lambda s: F.when(F.size(s) > 0, s).otherwise(other))
    best = let(F.slice(_by_score(scored), 1, 2), lambda b: F.filter(b, lambda x, i: (i == 0) | (x["score"] >= F.round(b[0]["score"] - 0.2, 6))))
    shown = F.array_distinct(F.concat(F.when(F.length(header) > 0, F.array(header)).otherwise(T.empty()), _in_order(best)))
    return F.when(F.size(rows) > 0, F.array_join(shown, " | "))


def quote(clean: Column, parts: Column, rows: Column, header: Column, tabular: Column, terms: Column, limits: tuple[int, ...]) -> Column:
    """What a text says to the question, cut to each of the limits: of a table its rows, else its sentences, else what is readable.
    Empty for an empty text; a table without rows shows its head."""
    told = F.when(tabular, F.coalesce(table_quote(rows, header, terms), T.truncate(clean, 180))).otherwise(sentence_quote(parts, terms))
    cut = lambda t: F.array(*[F.when(t.isNotNull(), T.truncate(t, n)).otherwise(T.best_quote(clean, n)) for n in limits])
    return F.when(F.length(T.squeeze(clean)) > 0, let(told, cut)).otherwise(F.array(*[F.lit("")] * len(limits)))


def mechanism_bonus(low: Column) -> Column:
    """What words of a mechanism add to a text, .32 at most."""
    each = [F.when(reduce(lambda a, b: a & b, [T.contains_any(low, group) for group in groups]), much).otherwise(0.0) for groups, much in fixed.MECHANISMS]
    return F.round(F.least(F.lit(0.32), reduce(lambda a, b: a + b, each)), 9)
