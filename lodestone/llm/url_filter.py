"""URL filters: rules by host and path first, then a weighted vocabulary that Aho-Corasick counts in the whole URL.

The automaton of all terms runs once over the URLs of an Arrow batch. A hit counts if neither neighbour is a letter a-z or a digit.
A strict term weighs as much as `least_soft` soft ones; a URL whose distinct terms reach that weight is blocked. No shuffle is
needed, so a hot host costs nothing.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: One of these is enough; of the soft ones it takes several.
STRICT = ("casino", "spam", "porn", "xxx", "viagra", "escort", "malware", "warez")
SOFT = ("cheap", "pills", "win", "bonus", "free", "bet", "poker", "loan", "replica", "crack", "torrent", "adult", "dating", "pharmacy")
#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules and terms are held by each task; larger lists are an error, not a slow query.
MOST_RULES, MOST_TERMS = 500, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a URL; both empty without a `://` or a URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, F.lit(r"(?s)^.*?://"), F.lit("")))
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null; of equally long ones a block goes before an allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, {MOST_RULES} at most")
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + start))
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<verdict: string, rule: string>")


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(term, (k, len(term)))
    out.make_automaton()
    return out


def distinct_hits(texts: list[str], terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, terms): which of the terms stand in each lower-cased text between boundaries, each once."""
    text = "\n" + "\n".join(texts) + "\n"
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    own = set("abcdefghijklmnopqrstuvwxyz0123456789")
    hits = [(end, k) for end, (k, size) in _automaton(terms).iter(text) if text[end + 1] not in own and text[end - size] not in own]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, term = np.array(hits).T
    pairs = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, term], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, least_soft: int = 2) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft, terms): a row for each row of pages.

    The longest rule that fits decides; without one, a strict term or `least_soft` distinct soft terms block. Terms are lower-case
    text without line breaks; a term in both lists is strict. A null URL is empty: no host, no path, no term, so allowed. Rows that
    repeat an id are judged each; other columns are not read.
    """
    strict = tuple(dict.fromkeys(strict))
    terms = strict + tuple(t for t in dict.fromkeys(soft) if t not in strict)
    if len(terms) > MOST_TERMS or any(not t or "\n" in t or t != t.translate(str.maketrans(_UPPER, _LOWER)) for t in terms):
        raise ValueError(f"terms are lower-case, not empty, without line breaks, and {MOST_TERMS} at most")
    names = np.array(terms, object)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        row, term = distinct_hits(batch.column("low").to_pylist(), terms) if len(terms) else (np.zeros(0, np.int64),) * 2
        is_strict = term < len(strict)
        counts = [pa.array(np.bincount(row[which], minlength=n).astype(np.int64)) for which in (is_strict, ~is_strict)]
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        found = pa.ListArray.from_arrays(offsets, pa.array(names[term].tolist(), pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *counts, found], ["id", "url", "n_strict", "n_soft", "terms"])

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER).alias("low"))
    kind = rows.schema["id"].dataType.simpleString()
    hits = common.by_batch(rows, each, f"id {kind}, url string, n_strict long, n_soft long, terms array<string>")
    host, path = host_and_path(F.col("url"))
    out = hits.withColumns({"host": host, "path": path}).withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules))
    weight = F.col("n_strict") * least_soft + F.col("n_soft")
    verdict = F.coalesce("ruled.verdict", F.when(weight >= least_soft, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft", "terms")
