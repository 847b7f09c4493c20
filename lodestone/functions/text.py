"""Features of texts and questions as native column expressions. Lengths and offsets count code points.

A null text counts as empty everywhere; results are then false, zero or empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CJK = "一-鿿"


def empty() -> Column:
    """An array of no strings."""
    return F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value; the value is computed once, however often the body names it and wherever."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(whole(text), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chars(text: Column, kind: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?U){kind}+", ""))


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def _spelt(text: Column) -> Column:
    out = F.translate(text, fixed.DASHES + fixed.SOFT_HYPHEN, "-" * len(fixed.DASHES))
    for ligature, letters in fixed.LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.when(contains_any(text, [*fixed.DASHES, fixed.SOFT_HYPHEN, *fixed.LIGATURES]), out).otherwise(text)


def sanitize(text: Column) -> Column:
    """Ligatures and dashes spelt plainly, words joined over a line's hyphen, e-mails and labelled personal data masked."""
    out = let(whole(text), lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(_spelt(t)))  # ASCII is plain
    out = let(out, lambda o: F.when(F.contains(o, F.lit("-")), F.regexp_replace(o, r"(?U)(?<=[A-Za-z])-\s+(?=[A-Za-z])", "")).otherwise(o))
    out = let(out, lambda o: F.when(F.contains(o, F.lit("@")), F.regexp_replace(o, r"(?U)[\w.\-+]++@[\w.\-]+\.\w+", fixed.HIDDEN_EMAIL)).otherwise(o))
    mask = lambda o, label: F.regexp_replace(o, rf"(?U)({label})\s*[:：]\s*\S+", f"$1：{fixed.HIDDEN}")
    return let(out, lambda o: F.when((F.length(o) < F.octet_length(o)) & contains_any(o, fixed.LABEL_STARTS), reduce(mask, fixed.MASKED_LABELS, o)).otherwise(o))


def lowered(text: Column) -> Column:
    """The form that markers are looked for in: sanitised, lower case, squeezed."""
    return squeeze(F.lower(sanitize(text)))


def truncate(text: Column, limit: int = 220) -> Column:
    """At most `limit` characters, cut at the last sentence mark or space if that is past 55 % of them, with dots."""
    clean = squeeze(text)
    head = F.substring(clean, 1, limit)
    marks = [F.when(F.contains(head, F.lit(m)), limit - F.instr(F.reverse(head), m)) for m in "。！？.; "]
    at = F.coalesce(F.greatest(*marks), F.lit(-1))
    at = F.when(at < int(limit * 0.55), limit).otherwise(at)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.regexp_replace(F.substr(clean, F.lit(1), at), "[ ,，;；.]+$", ""), F.lit("...")))


#: What ends a line.
LINE_END = r"[\n\r\x0B\f\x1C-\x1E\x85  ]"


def line_split(text: Column) -> Column:
    return F.split(whole(text), rf"\r\n|{LINE_END}")


def lines(text: Column) -> Column:
    return F.filter(line_split(text), lambda x: x.rlike(r"(?U)\S"))


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


def is_table(text: Column) -> Column:
    """Table-like as retrieval sees it."""

    def test(flat: Column) -> Column:
        ratio = let(lines(text), lambda rows: _share(F.size(F.filter(rows, lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t")))), F.size(rows)))
        digits, marks = _share(chars(flat, r"\d"), F.length(flat)), _share(chars(flat, r"[|,:：/\\]"), F.length(flat))
        dense = (F.length(flat) > 100) & (digits > 0.28) & (chars(flat, f"[{CJK}]") < 80)
        return (F.length(flat) > 0) & ((chars(flat, r"\|") >= 6) | (ratio >= 0.35) | dense | ((F.length(flat) > 120) & (marks > 0.22)))

    return let(squeeze(text), test)


def is_store_table(text: Column) -> Column:
    """Table-like as the chunk store sees it: by pipes and digits alone."""
    flat = squeeze(text)
    digits = _share(chars(flat, r"\d"), F.length(flat))
    return (F.length(flat) > 0) & ((chars(flat, r"\|") >= 6) | ((digits > 0.28) & (chars(flat, f"[{CJK}]") < 80) & (F.length(flat) > 100)))


def readability(text: Column) -> Column:
    flat = squeeze(text)
    score = F.lit(0.2) + F.when((chars(flat, f"[{CJK}]") >= 30) | (chars(flat, "[A-Za-z]") >= 30), 0.25).otherwise(0.0)
    score = score + F.when(flat.rlike("[。！？.!?；;]"), 0.2).otherwise(0.0) + F.when(F.length(flat).between(80, 1200), 0.15).otherwise(0.0)
    score = score - F.when(is_table(flat), 0.35).otherwise(0.0) - F.when(contains_any(flat, ["姓名", "学号", "电子邮件", "邮箱"]), 0.15).otherwise(0.0)
    return F.when(F.length(flat) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def overview_score(text: Column) -> Column:
    low = lowered(text)
    return F.least(F.lit(0.8), hits(low, fixed.STRONG_MARKERS) * 0.22 + hits(low, fixed.MEDIUM_MARKERS) * 0.08)


def is_front_matter(text: Column) -> Column:
    return let(lowered(text), _front_matter)


def _front_matter(low: Column) -> Column:
    labelled = (hits(low, fixed.FRONT_LABELS) >= 2) & (F.length(low) <= 360) & ~contains_any(low, fixed.BODY_MARKERS)
    cover = contains_any(low, ["作者", "单位", "日期"]) & contains_any(low, ["摘 要", "摘要"]) & ~contains_any(low, ["本文围绕", "研究认为", "in this paper", "in this work"]) & (F.length(low) <= 260)
    mails = (F.length(low) - F.length(F.replace(low, F.lit(fixed.HIDDEN_EMAIL), F.lit("")))) / len(fixed.HIDDEN_EMAIL) >= 3
    noise = contains_any(low, fixed.FRONT_NOISE) | labelled | low.rlike(r"(?i)^(摘\s*要|摘要|abstract)[:：]?$") | cover | mails
    return (F.length(low) == 0) | (~contains_any(low, fixed.FRONT_KEEP) & noise)


def trim_front(text: Column) -> Column:
    """Without a numbered heading in front, or what stands before a first marker within 260 characters."""
    clean = F.trim(F.regexp_replace(squeeze(text), r"(?i)^\d+(?:\.\d+)*\s+(?:abstract|introduction|background|conclusion|results?|model|experiments?)\s+", ""))
    out = clean
    for marker, drop in reversed([("Abstract ", True), ("摘要", True), ("1 Introduction ", True), ("Introduction ", True), ("In this work ", False), ("In this paper ", False)]):
        at = F.instr(clean, marker)
        out = F.when((at > 1) & (at <= 261), F.trim(F.substr(clean, at + (len(marker) if drop else 0), F.length(clean)))).otherwise(out)
    return out


def reference_markers(text: Column) -> Column:
    return count(whole(text), r"\[\d{1,3}\]")


def is_reference_section(text: Column) -> Column:
    flat = squeeze(text)
    return flat.rlike(r"(?i)\breferences\b") | (F.contains(flat, F.lit("参考文献")) & (reference_markers(flat) > 0))


def is_reference_continuation(text: Column) -> Column:
    flat = squeeze(text)
    return (reference_markers(flat) > 0) | flat.rlike(r"(教育|研究|Journal|Higher Education|University).{0,40}\d{4}")


def reliability(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(whole(text), F.lit(k)).cast("int") * w for k, w in fixed.RELIABILITY.items()])


def is_metadata(text: Column) -> Column:
    """A labelled field of a title page; an empty text counts, too."""
    return let(squeeze(sanitize(text)), _metadata)


def _metadata(flat: Column) -> Column:
    at = F.length(F.regexp_extract(flat, f"^(.*?){fixed.METADATA_LABEL}", 1))
    labelled = flat.rlike(fixed.METADATA_LABEL) & ((at <= 90) | (F.length(flat) <= 220))
    return (F.length(flat) == 0) | labelled | (F.contains(flat, F.lit("摘 要")) & (F.length(flat) <= 80))


def is_submission(text: Column) -> Column:
    """Instructions on handing in an assignment."""
    return contains_any(squeeze(sanitize(text)), fixed.SUBMISSION_NOISE)


def is_code(text: Column) -> Column:
    """Mostly code: eight marks of it, or 45 % of four or more lines; prose about a framework's parts needs the marks."""
    return let(sanitize(text), _code)


def _code(clean: Column) -> Column:
    most = reduce(lambda a, b: a + b, [(F.length(clean) - F.length(F.replace(clean, F.lit(m), F.lit("")))) / len(m) for m in fixed.CODE_MARKERS])
    many = F.when(most >= 8, count(clean, "(?=[" + "".join(sorted({m[0] for m in fixed.CODE_MARKERS})) + "])(?:" + "|".join("\\Q" + m + "\\E" for m in fixed.CODE_MARKERS) + ")") >= 8).otherwise(F.lit(False))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(clean), F.lit(r"(?U)\b(" + "|".join(fixed.FRAMEWORK_WORDS) + r")\b"), 1)))
    like_code = lambda x: contains_any(x, fixed.CODE_STARTS) & x.rlike("(?U)" + fixed.CODE_LINE)
    rows = let(lines(clean), lambda rows: (F.size(rows) >= 4) & (_share(F.size(F.filter(rows, like_code)), F.size(rows)) >= 0.45))
    return many | (rows & (words < 3))


def noise_kinds(text: Column) -> Column:
    """The kinds of noise that a text is, each by the function of its name, in a struct; the text is sanitised once."""

    def kinds(clean: Column) -> Column:
        by_flat = let(squeeze(clean), lambda flat: F.struct(_metadata(flat).alias("metadata"), contains_any(flat, fixed.SUBMISSION_NOISE).alias("submission")))
        named = [let(squeeze(F.lower(clean)), _front_matter).alias("front_matter"), _code(clean).alias("code"), is_table(clean).alias("table"), is_reference_section(text).alias("references")]
        return F.struct(by_flat.alias("flat"), *named)

    return let(let(sanitize(text), kinds), lambda k: F.struct(k["flat"]["metadata"].alias("metadata"), k["flat"]["submission"].alias("submission"), *[k[n].alias(n) for n in ("front_matter", "code", "table", "references")]))


def noise_penalty(text: Column, section: Column | None = None, metadata_asked: Column | None = None, references_asked: Column | None = None, flags: dict[str, Column] | None = None, kinds: Column | None = None) -> Column:
    """What noise costs a text, by what its question asks for. `flags` may hold asks_submission, asks_code, asks_table, and
    no_submission, no_code, no_table for kinds that the plan of the question excludes; all are false by default. `kinds` is the text's
    noise_kinds where that is at hand."""
    if kinds is None:
        return let(noise_kinds(text), lambda k: noise_penalty(text, section, metadata_asked, references_asked, flags, k))
    no = F.lit(False)
    flag = lambda name: no if flags is None or name not in flags else flags[name]
    cost = lambda test, much: F.when(test, much).otherwise(F.lit(0.0))
    meta, refs = no if metadata_asked is None else metadata_asked, no if references_asked is None else references_asked
    cited = kinds["references"] if section is None else kinds["references"] | F.coalesce(section == "References", no)
    return (
        cost(kinds["front_matter"], F.when(meta, 0.3).otherwise(1.8)) + cost(kinds["metadata"] & ~meta, F.lit(1.0)) + cost(cited & ~refs, F.lit(1.45))
        + cost(kinds["submission"] & ~flag("asks_submission"), F.when(flag("no_submission"), 1.45).otherwise(0.7))
        + cost(kinds["code"] & ~flag("asks_code"), F.when(flag("no_code"), 1.0).otherwise(0.55))
        + cost(kinds["table"] & ~flag("asks_table"), F.when(flag("no_table"), 0.95).otherwise(0.45))
    )


#: What a sanitised text in lower case must have to be front matter or metadata, instructions or a list of references, if it isn't blank: one of
#: these phrases (which are looked for where the longest word of one is) or signs, of which one stands for hidden text that may have been any.
_NOISE_PHRASES = [*fixed.FRONT_NOISE, "references"]
_NOISE_SIGNS = ["摘", "机构", "参考文献", fixed.HIDDEN[1:], *fixed.FRONT_LABELS, *fixed.SUBMISSION_NOISE]
#: What a text can cost that is code and table-like at once.
_CODE_AND_TABLE = 0.55 + 0.45


def is_quiet(text: Column, low: Column, limit: float) -> Column:
    """Whether noise costs a text less than `limit` for an ordinary question. `low` is the sanitised text in lower case; most texts have
    nothing that any costly kind of noise must have, so that no kind is looked for in them."""
    if limit <= _CODE_AND_TABLE:
        return noise_penalty(text) < limit
    spaced = "(?U)" + "|".join(r"\s+".join(p.split()) for p in _NOISE_PHRASES)
    phrase = F.when(contains_any(low, [max(p.split(), key=len) for p in _NOISE_PHRASES]), low.rlike(spaced)).otherwise(False)
    sign = F.when(F.length(low) < F.octet_length(low), contains_any(low, _NOISE_SIGNS)).otherwise(False)
    return F.when(phrase | sign | ~low.rlike(r"(?U)\S"), noise_penalty(text) < limit).otherwise(True)


def best_quote(text: Column, limit: int = 280) -> Column:
    """A short text whole; else its first sentences that aren't table-like, as many as fit; else its head."""
    flat = squeeze(text)
    plain = F.filter(sentences(flat), lambda s: ~is_store_table(s))
    start = F.struct(F.lit("").alias("quote"), F.lit(True).alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        fits = state["open"] & (F.length(state["quote"]) + F.length(sentence) <= limit)
        return F.struct(F.when(fits, F.concat(state["quote"], sentence)).otherwise(state["quote"]).alias("quote"), fits.alias("open"))

    quote = F.aggregate(plain, start, add)["quote"]
    return F.when((F.length(flat) <= limit) & ~is_store_table(flat), flat).when(F.length(quote) > 0, quote).otherwise(F.substring(flat, 1, limit))


def is_visual_item(chunk_type: Column, image_id: Column) -> Column:
    return F.coalesce(F.length(image_id.cast("string")) > 0, F.lit(False)) | contains_any(F.lower(whole(chunk_type)), ["image", "figure", "chart"])


def is_table_item(chunk_type: Column, text: Column) -> Column:
    return F.contains(F.lower(whole(chunk_type)), F.lit("table")) | is_table(sanitize(text))


def noise_flags(text: Column) -> Column:
    """Names of the kinds of noise that a chunk shows."""
    named = [("front_matter", is_front_matter(text)), ("reference_section", is_reference_section(text)), ("table_like", is_table(text))]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named]))


def page_label(start: Column, end: Column, page: Column) -> Column:
    """'3-5', or one page; a missing page is 0."""
    known = lambda c: F.nullif(c, F.lit(0))
    first = F.coalesce(known(start), known(page))
    last = F.coalesce(known(end), first)
    return F.when((first != last), F.concat_ws("-", first, last)).otherwise(F.coalesce(first, F.lit(0)).cast("string"))


# ------------------------------------------------------------------ tokens


#: Letters and digits one by one, as Java looks up single characters at once and ranges one after the other.
LETTER, ALNUM = f"[{ascii_letters}]", f"[{ascii_letters}{digits}]"
#: A character of a run of letters and digits, where runs are joined by single hyphens and apostrophes.
RUN = f"(?:{ALNUM}|(?<={ALNUM})[-'](?={ALNUM}))"


def is_joined(text: Column) -> Column:
    """Whether a text may have joined runs."""
    return F.contains(whole(text), F.lit("-")) | F.contains(whole(text), F.lit("'"))


def token_count(text: Column) -> Column:
    """Tokens without a tokenizer: a CJK character is 1, a run of letters and digits a quarter of its length, any other 1."""
    ended = F.concat(whole(text), F.lit("."))  # takes white space at the end with it
    tokens = lambda run: F.length(F.regexp_replace(ended, rf"(?U)\s*(?:{run}|\S)", "x")) - 1
    return F.when(is_joined(text), tokens(RUN + "{1,4}+")).otherwise(tokens(ALNUM + "{1,4}"))


def sentences(text: Column) -> Column:
    """Sentences with their marks, trimmed."""
    return F.filter(F.transform(F.split(whole(text), "(?<=[。！？.!?；;])"), strip), lambda s: F.length(s) > 0)


def _grams(run: Column, size: int) -> Column:
    n = F.length(run) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(run, i, F.lit(size)))).otherwise(empty())


def tokens(text: Column, most: int | None = None, clean: Column | None = None) -> Column:
    """Search tokens: lower-case words of two or more, and of runs of CJK characters their pairs and triples; all of a text, or the
    first `most`. `clean` is the sanitised text where that is at hand."""
    clean = sanitize(text) if clean is None else clean
    runs = F.regexp_extract_all(F.lower(clean), F.lit(f"[a-z0-9]{{2,}}|[{CJK}]{{2,}}"), 0)

    def grown(run: Column) -> Column:
        short = F.when(F.length(run) <= 4, F.array(run)).otherwise(empty())
        triples = F.when(F.length(run) >= 4, _grams(run, 3)).otherwise(empty())
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(short, _grams(run, 2), triples)).otherwise(F.array(run))

    every = F.filter(F.flatten(F.transform(runs, grown)), lambda t: ~t.isin(fixed.TOKEN_BLOCKED))
    found = F.when(clean.rlike(f"[{CJK}]"), every).otherwise(runs)  # only CJK words are blocked
    return found if most is None else F.slice(found, 1, most)


def question_keywords(question: Column) -> Column:
    """The terms of a question, first met first, 40 at most."""
    asked = F.lower(whole(question))
    for stop in fixed.QUESTION_STOP:
        asked = F.replace(asked, F.lit(stop), F.lit(" "))
    known = F.filter(F.array(*[F.lit(t) for t in fixed.QUESTION_TERMS]), lambda t: F.contains(whole(question), t))
    runs = F.regexp_extract_all(asked, F.lit(f"[{CJK}]{{2,}}"), 0)
    grown = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.concat(_grams(r, 2), _grams(r, 3)))))
    every = F.concat(known, F.regexp_extract_all(asked, F.lit("[a-z0-9]{2,}"), 0), grown)
    return F.slice(F.array_distinct(F.filter(every, lambda t: (F.length(t) >= 2) & ~t.isin(fixed.QUESTION_BLOCKED))), 1, 40)


def question_phrases(question: Column) -> Column:
    """Runs of 4, 3 and 2 content words that have a word of five letters, 18 at most."""
    words = F.regexp_extract_all(lowered(question), F.lit(r"[a-z0-9][a-z0-9\-]*"), 0)
    content = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.PHRASE_STOP))

    def of(size: int) -> Column:
        n = F.size(content) - size + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(content, i, F.lit(size)))
        runs = F.filter(runs, lambda r: F.exists(r, lambda w: F.length(w) >= 5))
        return F.when(n > 0, F.transform(runs, lambda r: squeeze(F.replace(F.array_join(r, " "), F.lit("-"), F.lit(" "))))).otherwise(empty())

    return F.slice(F.array_distinct(F.filter(F.concat(of(4), of(3), of(2)), lambda p: F.length(p) >= 5)), 1, 18)


def relevance(question: Column, keywords: Column, phrases: Column, low: Column) -> Column:
    """How well a text (in `lowered` form) answers a question with the given keywords and phrases, 0 to 1."""
    part = lambda found, of: F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(0.0)
    exact = part(F.filter(keywords, lambda t: F.contains(low, F.lower(t))), keywords)
    plain = F.replace(low, F.lit("-"), F.lit(" "))
    phrase = F.when(F.size(phrases) > 0, F.size(F.filter(phrases, lambda p: F.contains(plain, p))) / F.least(F.size(phrases), F.lit(6))).otherwise(0.0)
    chars = F.filter(F.regexp_extract_all(whole(question), F.lit(f"[{CJK}]"), 0), lambda c: ~F.contains(F.lit(fixed.MEANINGLESS_CHARS), c))
    char = part(F.filter(chars, lambda c: F.contains(low, c)), chars)
    return F.when(F.length(low) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), exact * 0.55 + phrase * 0.3 + char * 0.15)))


def evaluation_form(text: Column) -> Column:
    """The form in which evaluation compares: plain letters, no hyphenation, no thousands commas, lower case."""
    out = F.translate(whole(text), fixed.DASHES + fixed.SOFT_HYPHEN, "-" * len(fixed.DASHES))
    for ligature, letters in fixed.LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    out = F.regexp_replace(out, r"(?U)(?<=[A-Za-z])-\s+(?=[A-Za-z])", "")
    return squeeze(F.lower(F.regexp_replace(out, r"(?<=\d),(?=\d)", "")))


def term_rate(terms: Column, form: Column) -> Column:
    """The share of terms that a text (in `evaluation_form`) has; a term may list alternatives with |. 1 without terms."""
    met = F.filter(terms, lambda t: F.exists(F.split(t, r"\|"), lambda a: F.contains(form, evaluation_form(a)) & (F.length(F.trim(a)) > 0)))
    return F.when(F.size(F.coalesce(terms, empty())) > 0, F.size(met) / F.size(terms)).otherwise(1.0)
