"""The training-data queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, hard_negatives, learning, metric_join, mixing, packing, pii, quality, simhash, substring_dedup, topk, toxicity, url_filter
from .pii_sql import OP1_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM split, unnest(range(1, len(words) - 11)) AS t(i)),
     first AS (SELECT run, min(doc_id) AS first_doc FROM win GROUP BY run),
     cover AS (SELECT DISTINCT doc_id, i + shift AS place
               FROM win JOIN first USING (run), unnest(range(13)) AS s(shift) WHERE doc_id > first_doc),
     word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
     kept AS (SELECT w.doc_id, count(*) FILTER (c.place IS NOT NULL) AS n_removed,
                     string_agg(word, ' ' ORDER BY w.place) FILTER (c.place IS NULL) AS kept
              FROM word w LEFT JOIN cover c ON w.doc_id = c.doc_id AND w.place = c.place GROUP BY w.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (learning.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
                        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
     reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
     low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
     n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select(F.floor(F.col("conv_id") / 2).alias("pair_id")).where("pair_id is not null").distinct()
    return chat.preference_pairs(turns, pairs.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id")))


OP5_SQL = """
WITH turn AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM turn),
     pair AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM turn),
     total AS (SELECT p.pair_id, count(*) FILTER (t.conv_id % 2 = 0) AS nc, count(*) FILTER (t.conv_id % 2 = 1) AS nr
               FROM pair p JOIN placed t ON t.conv_id // 2 = p.pair_id GROUP BY 1),
     differs AS (SELECT p.pair_id, min(a.n) AS n FROM pair p JOIN placed a ON a.conv_id // 2 = p.pair_id
                 LEFT JOIN placed b ON b.conv_id = a.conv_id + 1 - 2 * (a.conv_id % 2) AND b.n = a.n AND b.role = a.role AND b.text = a.text
                 WHERE b.n IS NULL GROUP BY 1),
     common AS (SELECT pair_id, (coalesce(d.n - 1, nc))::INTEGER AS n_common FROM total LEFT JOIN differs d USING (pair_id)),
     shown AS (SELECT c.pair_id, c.n_common, t.conv_id % 2 AS side, t.n, t.role, '<|' || t.role || '|>\n' || t.text || '<|end|>\n' AS line,
                      length(t.role) + 5 AS head, t.n > c.n_common AS own
               FROM common c JOIN placed t ON t.conv_id // 2 = c.pair_id),
     spot AS (SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, side, own ORDER BY n) - length(line) AS pos FROM shown)
SELECT c.pair_id, 2 * c.pair_id AS chosen_id, 2 * c.pair_id + 1 AS rejected_id, c.n_common,
       coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND NOT own), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND own), '') AS chosen,
       coalesce(string_agg((pos + head)::VARCHAR || ':' || (pos + length(line) - 1)::VARCHAR, ',' ORDER BY n) FILTER (side = 0 AND own AND role = 'assistant'), '') AS chosen_learned,
       coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 1 AND own), '') AS rejected,
       coalesce(string_agg((pos + head)::VARCHAR || ':' || (pos + length(line) - 1)::VARCHAR, ',' ORDER BY n) FILTER (side = 1 AND own AND role = 'assistant'), '') AS rejected_learned
FROM common c JOIN spot USING (pair_id) GROUP BY c.pair_id, c.n_common
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (learning.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The production mix: three domains of sources, English held to two fifths, at most two epochs of anything.
MIX = {"domain": {"d0": 0.5, "d1": 0.3, "d2": 0.2}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def domain_of_source() -> Column:
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0)) % 3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), domain_of_source(), MIX)
    return out.select("row.doc_id", "domain", "lang", "source", "epoch", "tokens", "take")


def _mix_level(name: str, below: str, keys: str, above: str, weight: str) -> str:
    return f"""
     {name}_n AS (SELECT {keys}, sum(capacity) AS room, any_value(part) AS share, {weight} AS weight FROM {below} GROUP BY {keys}),
     {name}_l AS (SELECT *, (share - coalesce(sum(room) OVER (PARTITION BY {above} ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (PARTITION BY {above} ORDER BY room / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_n),
     {name}_b AS (SELECT *, greatest(0, least(room, weight * max(level) OVER (PARTITION BY {above}))) AS got FROM {name}_l),
     {name}_p AS (SELECT l.* EXCLUDE (part), b.got AS part FROM {below} l JOIN {name}_b b USING ({keys})),"""


OP7_SQL = (
    """
WITH doc AS (SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS INTEGER), 0) % 3 AS domain, coalesce(lang, '') AS lang,
                    coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
     held_doc AS (SELECT * FROM doc WHERE tokens > 0),
     leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS held, sum(tokens) * 2.0::DOUBLE AS capacity,
                     floor(0.6::DOUBLE * (SELECT sum(tokens) FROM held_doc)) AS part FROM held_doc GROUP BY ALL),"""
    + _mix_level("domain", "leaf", "domain", "0", "CASE domain WHEN 'd0' THEN 0.5::DOUBLE WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 ELSE 1.0 END")
    + _mix_level("lang", "domain_p", "domain, lang", "domain", "CASE lang WHEN 'en' THEN 0.4::DOUBLE WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 1.0 END")
    + _mix_level("source", "lang_p", "domain, lang, source", "domain, lang", "1.0::DOUBLE")
    + """
     plan AS (SELECT domain, lang, source, held, floor(part + 1e-3)::BIGINT AS budget FROM source_p),
     turn AS (SELECT p.*, unnest(range(budget // held + 1)) AS epoch FROM plan p),
     placed AS (SELECT d.*, t.epoch, t.budget - t.epoch * t.held AS left_,
                       sum(d.tokens) OVER (PARTITION BY domain, lang, source, t.epoch ORDER BY md5('17:' || t.epoch || ':' || d.doc_id)) - d.tokens AS pos
                FROM held_doc d JOIN turn t USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch, tokens, greatest(0, least(tokens, left_ - pos))::BIGINT AS take FROM placed WHERE pos < left_
"""
)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     score AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
               FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM score QUALIFY rank <= 20
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.withColumn("terms", F.array_join(F.array_sort("terms"), ","))


def _url_terms(terms: list[str]) -> str:
    return "[x FOR x IN [" + ", ".join(f"'{t}'" for t in terms) + "] IF regexp_matches(low, '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)')]"


_STRICT_URL = ["casino", "spam", "porn", "xxx", "viagra", "escort", "malware", "warez"]
_SOFT_URL = ["cheap", "pills", "win", "bonus", "free", "bet", "poker", "loan", "replica", "crack", "torrent", "adult", "dating", "pharmacy"]

OP11_SQL = f"""
WITH low AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
     part AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM low),
     seen AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_url_terms(_STRICT_URL)} AS strict_hits, {_url_terms(_SOFT_URL)} AS soft_hits FROM part),
     ruled AS (SELECT *, CASE WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                              WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                              WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                              WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                              WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM seen)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN len(strict_hits) > 0 OR len(soft_hits) > 1 THEN 'block' ELSE 'allow' END AS verdict,
       len(strict_hits)::BIGINT AS n_strict, len(soft_hits)::BIGINT AS n_soft, array_to_string(list_sort(strict_hits || soft_hits), ',') AS terms
FROM ruled
"""


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): turns with the faults that the contract plants by a hash of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.repair(damaged(turns)), turns)


#: A CRC-32 bit by bit over bytes, each followed by seven zeros; then the search, one row of each conversation a step.
OP12_SQL = r"""
WITH RECURSIVE
  coded AS (SELECT coalesce(conv_id, -1) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
  named AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(key, '')])),
                   lambda h, b: xor(xor(h, b) >> 1, 3988292384 * (xor(h, b) & 1))), 4294967295::BIGINT) % 20 AS kind FROM coded),
  hurt AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM named),
  placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
  seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY n) AS nth, right(rtrim(text, e' 	
'), 1) AS final,
                  lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before FROM placed),
  fault AS (SELECT *, left(role, 1) AS initial, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
  counted AS (SELECT c, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY c),
  way(state, target, added, letters, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
       (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
       (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
  kept(state, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
  given(state, role, target) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
  found(c, n, state, cost, audit, lines) AS (
    SELECT DISTINCT c, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM fault
    UNION ALL
    SELECT c, n, state, cost, audit, lines FROM (
      SELECT *, row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) AS best FROM (
        SELECT f.c, t.n, w.target AS state, f.cost + w.added + 3 AS cost, f.audit || w.letters || 'D' AS audit, f.lines || w.lines AS lines
        FROM found f JOIN fault t ON t.c = f.c AND t.n = f.n + 1 JOIN way w ON w.state = f.state
        UNION ALL
        SELECT f.c, t.n, k.target, f.cost + w.added + (t.fault = 'truncated')::INTEGER, f.audit || w.letters || 'K', f.lines || w.lines || [t.role || ':' || t.text]
        FROM found f JOIN fault t ON t.c = f.c AND t.n = f.n + 1 JOIN way w ON w.state = f.state JOIN kept k ON k.state = w.target AND k.initial = t.initial
        WHERE t.fault NOT IN ('blank', 'duplicate')
        UNION ALL
        SELECT f.c, t.n, g.target, f.cost + w.added + 2 + (t.fault = 'truncated')::INTEGER, f.audit || w.letters || 'R', f.lines || w.lines || [g.role || ':' || t.text]
        FROM found f JOIN fault t ON t.c = f.c AND t.n = f.n + 1 JOIN way w ON w.state = f.state JOIN given g ON g.state = w.target
        WHERE t.fault NOT IN ('blank', 'duplicate'))) WHERE best = 1),
  done AS (SELECT f.c, f.cost + w.added AS cost, f.audit || w.letters AS audit, f.lines || w.lines AS lines,
                  row_number() OVER (PARTITION BY f.c ORDER BY f.cost + w.added, f.audit || w.letters) AS best
           FROM found f JOIN counted k ON k.c = f.c AND k.rows_ = f.n JOIN way w ON w.state = f.state WHERE w.target IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM coded) o LEFT JOIN counted USING (c) LEFT JOIN (SELECT * FROM done WHERE best = 1) d USING (c)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     score AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
               FROM good a JOIN good c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
     positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM score WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN score USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_embedding_join": op3_embedding_join,
        "op4_packing": op4_packing,
        "op5_chat": op5_chat,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_topk": op8_topk,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
        "op11_url_filter": op11_url_filter,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": OP1_SQL,
        "op3_embedding_join": OP3_SQL,
        "op5_chat": OP5_SQL,
        "op7_mixing": OP7_SQL,
        "op8_topk": OP8_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_url_filter": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
