"""The SQL twin of evidence_units (DuckDB), in steps: chunks, sentences, table rows, quotes, scores, and the two stages of expansion."""

from __future__ import annotations

from .oracles import _BM25, _STORE_TABLE, _TABLE, _clean, _count, _flat

_STOP = "'what', 'which', 'where', 'when', 'how', 'does', 'did', 'is', 'are', 'was', 'were', 'the', 'this', 'that', 'for', 'and', 'with', 'from', 'reported', 'report'"
_QUOTED = r"\b[0-9]+(?:\.[0-9]+)?\s*(?:%|m|b|k|million|billion)?\b"
_UNIT = r"\b[0-9]+(?:\.[0-9]+)?\s*(?:%|x|times|m|b|k|million|billion)?\b"


def _any(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _sum(text: str, *terms: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


def _if(test: str, much: str) -> str:
    return f"CASE WHEN {test} THEN {much}::DOUBLE ELSE 0 END"


def _marked(text: str) -> str:
    return rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"


def _met(low: str) -> str:
    return f"len(list_filter(terms, lambda t: contains({low} || chr(10) || {_marked(low)}, t)))"


def _cut(x: str, limit: int) -> str:
    """T.truncate of a squeezed text."""
    marks = ", ".join(f"CASE WHEN contains({x}[:{limit}], '{m}') THEN {limit} - strpos(reverse({x}[:{limit}]), '{m}') ELSE -1 END" for m in "。！？.; ")
    at = f"list_max([{marks}])"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE regexp_replace({x}[:CASE WHEN {at} < {int(limit * 0.55)} THEN {limit} ELSE {at} END], '[ ,，;；.]+$', '') || '...' END"


_MECHANISM = f"""round(least(0.32::DOUBLE, {_if(_any('low', 'we propose', 'propose', 'proposed', 'method', 'approach'), '0.06')} + {_if(_any('low', 'using', 'by ', 'inject', 'injected', 'scale', 'scaling'), '0.04')}
    + {_if("contains(low, 'compound') AND " + _any('low', 'coefficient', 'scaling'), '0.12')} + {_if("contains(low, 'width') AND contains(low, 'depth') AND contains(low, 'resolution')", '0.1')}
    + {_if(_any('low', 'rank decomposition', 'low-rank', 'low rank'), '0.12')} + {_if(_any('low', 'freeze', 'freezes', 'frozen') + " AND contains(low, 'weight')", '0.1')}
    + {_if("contains(low, 'trainable') AND " + _any('low', 'parameter', 'matrix', 'matrices'), '0.08')} + {_if(_any('low', 'efficiency', 'efficient', 'memory', 'flops', 'latency', 'faster', 'smaller'), '0.05')}), 9)"""


def _relevance(low: str) -> str:
    return f"""greatest(0, least(1, len(list_filter(ks, lambda k: contains({low}, k))) / greatest(1, len(ks)) * 0.55::DOUBLE
        + len(list_filter(ps, lambda p: contains(replace({low}, '-', ' '), p))) / greatest(1, least(6, len(ps))) * 0.3::DOUBLE))"""


def _support(kind: str) -> str:
    return f"""round(0.42::DOUBLE + {_relevance('low')} * 0.55::DOUBLE + least(len(list_filter(ks[:18], lambda k: contains(low, k))), 5) * 0.035::DOUBLE
        + least(len(list_filter(ps[:8], lambda p: contains(low, p))), 3) * 0.08::DOUBLE + CASE WHEN NOT regexp_matches(low, '{_UNIT}') THEN 0 WHEN numeric_asked THEN 0.24::DOUBLE ELSE 0.1::DOUBLE END
        + {kind}::DOUBLE + CASE WHEN mechanism THEN {_MECHANISM} ELSE 0 END, 9)"""


def _readable(limit: int) -> str:
    """T.best_quote of the chunks, as (doc_id, chunk_no, quote)."""
    return f"""SELECT d.doc_id, d.chunk_no, CASE WHEN length(flat) <= {limit} AND NOT store_table THEN flat ELSE coalesce(quote, flat[:{limit}]) END AS quote
        FROM (SELECT doc_id, chunk_no, flat, {_STORE_TABLE} AS store_table FROM chunk) d LEFT JOIN (SELECT doc_id, chunk_no, string_agg(flat, '' ORDER BY n) AS quote FROM readable WHERE upto <= {limit} GROUP BY ALL) r ON d.doc_id = r.doc_id AND d.chunk_no = r.chunk_no"""


_KEY = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))[:260]"
_SPLIT = r"string_split(regexp_replace(text, '([.!?。！？；;])\s+|\n+', '\1' || chr(1), 'g'), chr(1))"
_COMMAS = r"list_filter(list_transform(string_split(regexp_replace(p, '([,，;；])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20)"

SQL = {
    "evidence_units": rf"""
WITH {_BM25},
     hit AS MATERIALIZED (SELECT qid, doc_id, rank, round(raw / (raw + 3), 6) AS score FROM bm WHERE rank <= 12),
     line AS (SELECT doc_id, coalesce(source, '') AS section, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)),
     part AS (SELECT doc_id, any_value(section) AS section, i // 3 AS chunk_no, string_agg(text, chr(10) ORDER BY i) AS text FROM line GROUP BY doc_id, i // 3),
     clean AS MATERIALIZED (SELECT doc_id, section, chunk_no, text AS raw_text, {_clean('text')} AS text FROM part WHERE {_flat('text')} <> ''),
     chunk AS MATERIALIZED (SELECT *, {_TABLE} AS tabular FROM (SELECT *, {_flat('text')} AS flat, {_flat('lower(text)')} AS low FROM clean)),
     focus AS (SELECT qid, term, min(p) AS p FROM (SELECT qid, n AS p, token AS term FROM keyword UNION ALL SELECT qid, 1000 + n, phrase FROM kept WHERE n < 8
               UNION ALL SELECT item_id, 2000 + generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+'), 1), unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+')) FROM benchmark) WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
     needle AS (SELECT qid, CASE WHEN regexp_full_match(term, '[a-z0-9][a-z0-9\-]*') THEN {_marked('term')} || CASE WHEN ends_with(term, '-') THEN chr(1) ELSE '' END ELSE term END AS needle, row_number() OVER (PARTITION BY qid ORDER BY p) AS nth FROM focus QUALIFY nth <= 32),
     q AS MATERIALIZED (SELECT item_id AS qid, coalesce((SELECT list(token ORDER BY n) FROM keyword k WHERE k.qid = item_id), []) AS ks, coalesce((SELECT list(phrase ORDER BY n) FROM kept k WHERE k.qid = item_id), []) AS ps, coalesce((SELECT list(needle ORDER BY nth) FROM needle k WHERE k.qid = item_id), []) AS terms,
               {_any('lower(text)', '结果', 'result', 'results', 'table', '表格', '指标', 'metric', 'score', 'accuracy', 'error', 'benchmark')} OR regexp_matches(lower(text), '\b(?:efficiency|efficient|resource|memory|parameter|parameters|compute|storage|throughput|latency|speedup|faster|smaller|cost)\b') AS numeric_asked,
               {_any(f"lower({_clean('text')})", 'how', 'why', 'pursue', 'achieve', 'improve', 'approach', 'method', 'mechanism', 'compare', '如何', '怎么', '怎样', '机制', '方法', '对比')} AS mechanism FROM benchmark),
     cand AS MATERIALIZED (SELECT h.qid, h.doc_id, h.rank, h.score, c.chunk_no FROM hit h JOIN chunk c USING (doc_id) JOIN q USING (qid) QUALIFY row_number() OVER (PARTITION BY h.qid, h.doc_id ORDER BY round({_relevance('c.low')}, 9) DESC, c.chunk_no) = 1),
     anchor AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS anchor_no FROM cand),
     pair AS MATERIALIZED (SELECT a.qid, a.anchor_no, a.score AS anchor_score, c.doc_id, c.chunk_no, abs(c.chunk_no - a.chunk_no) AS gap,
               CASE WHEN c.chunk_no = a.chunk_no THEN 0.18::DOUBLE WHEN abs(c.chunk_no - a.chunk_no) = 1 THEN 0.12::DOUBLE WHEN c.chunk_no // 4 = a.chunk_no // 4 THEN 0.09::DOUBLE WHEN abs(c.chunk_no - a.chunk_no) = 2 THEN 0.08::DOUBLE
                    WHEN abs(c.chunk_no - a.chunk_no) <= 6 AND section <> '' THEN 0.07::DOUBLE END AS bonus FROM anchor a JOIN chunk c USING (doc_id)),
     place AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, anchor_no ORDER BY gap, bonus DESC, chunk_no) AS place FROM pair WHERE bonus IS NOT NULL QUALIFY place <= 10),
     piece AS (SELECT doc_id, chunk_no, unnest(ss) AS text, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, chunk_no, flatten(list_transform(list_transform({_SPLIT}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda p: CASE WHEN length(p) > 420 AND regexp_matches(p, '[,，;；]') THEN {_COMMAS} ELSE [p] END)) AS ss FROM clean)),
     sentence AS MATERIALIZED (SELECT doc_id, chunk_no, flat AS s, row_number() OVER w - 1 AS n, lead(flat) OVER w AS after FROM (SELECT *, text AS flat FROM piece) WHERE length(flat) >= 8 AND NOT {_TABLE} WINDOW w AS (PARTITION BY doc_id, chunk_no ORDER BY i)),
     trow_a AS (SELECT doc_id, chunk_no, flat, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '[:|\-\s]+')),
               lambda x: CASE WHEN contains(x, '|') THEN array_to_string(list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> ''), ' | ') ELSE x END), lambda x: x <> '') AS rs FROM chunk WHERE tabular),
     trow_b AS (SELECT doc_id, chunk_no, CASE WHEN len(rs) <= 1 THEN list_filter(string_split(regexp_replace(flat, '([0-9])\s+([A-Z][A-Za-z0-9 /-]{{2,}}\s+[0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') ELSE rs END AS rs FROM trow_a),
     trow AS MATERIALIZED (SELECT doc_id, chunk_no, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS n, coalesce(list_filter(rs[:3], lambda x: {_any('lower(x)', 'metric', 'score', 'accuracy', 'error', 'model', 'method', 'dataset', '指标', '结果')} AND {_count('x', '[0-9]')} < 4)[1], '') AS header FROM trow_b),
     scope AS MATERIALIZED (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY anchor_no) AS doc_no FROM anchor),
     asked AS MATERIALIZED (SELECT * FROM scope JOIN q USING (qid)),
     told AS (SELECT a.qid, s.doc_id, s.chunk_no, s.n, s.s, row_number() OVER (PARTITION BY a.qid, s.doc_id, s.chunk_no ORDER BY points DESC, s.n) AS nth
              FROM (SELECT a.qid, e.*, {_met('lower(e.s)')} + {_if(f"regexp_matches(lower(e.s), '{_QUOTED}')", '0.35')} + {_if(_any('lower(e.s)', 'we propose', 'we present', 'we show', 'result', 'dataset', 'method'), '0.2')} AS points FROM asked a JOIN sentence e USING (doc_id) JOIN chunk c ON c.doc_id = e.doc_id AND c.chunk_no = e.chunk_no WHERE NOT c.tabular) s JOIN scope a ON a.qid = s.qid AND a.doc_id = s.doc_id WHERE points > 0 QUALIFY nth <= 2),
     trow_p AS (SELECT a.qid, t.*, round({_met('lower(t.r)')} + least(3, {_count('lower(t.r)', _QUOTED)}) * 0.35::DOUBLE + {_sum('lower(t.r)', 'accuracy', 'error', 'score', 'metric', 'result', 'auc', 'f1', '%', '结果', '指标')} * 0.45::DOUBLE, 6) AS own,
                       round({_count('t.r', '[0-9]')} * 0.05::DOUBLE + {_if("contains(t.r, '|')", '0.2')}, 6) AS plain FROM asked a JOIN trow t USING (doc_id) WHERE t.r <> t.header),
     trow_s AS (SELECT *, CASE WHEN max(own) OVER w > 0 THEN own ELSE plain END AS points FROM trow_p WINDOW w AS (PARTITION BY qid, doc_id, chunk_no) QUALIFY own > 0 OR max(own) OVER w <= 0),
     trow_n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, chunk_no ORDER BY points DESC, n) AS nth, max(points) OVER (PARTITION BY qid, doc_id, chunk_no) AS top FROM trow_s QUALIFY nth <= 2),
     trow_q AS (SELECT qid, doc_id, chunk_no, any_value(header) AS header, list(r ORDER BY n) AS rs FROM trow_n WHERE nth = 1 OR points >= round(top - 0.2::DOUBLE, 6) GROUP BY ALL),
     spoken AS (SELECT qid, doc_id, chunk_no, string_agg(s, ' ' ORDER BY n) AS told FROM told GROUP BY ALL
                UNION ALL SELECT qid, doc_id, chunk_no, CASE WHEN header <> '' THEN header || ' | ' ELSE '' END || CASE WHEN len(rs) = 2 AND rs[1] = rs[2] THEN rs[1] ELSE array_to_string(rs, ' | ') END FROM trow_q),
     plain_s AS (SELECT doc_id, chunk_no, unnest(ps) AS flat, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, chunk_no, list_filter(list_transform(regexp_extract_all(flat, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM chunk)),
     readable AS (SELECT *, sum(length(flat)) OVER (PARTITION BY doc_id, chunk_no ORDER BY n) AS upto FROM plain_s WHERE NOT {_STORE_TABLE}),
     quoted AS (SELECT a.qid, c.doc_id, c.chunk_no, 2 AS kind_no, CASE WHEN told IS NOT NULL THEN {_cut('told', 360)} ELSE quote END AS unit FROM scope a JOIN chunk c USING (doc_id) LEFT JOIN spoken s ON s.qid = a.qid AND s.doc_id = c.doc_id AND s.chunk_no = c.chunk_no JOIN ({_readable(360)}) r ON r.doc_id = c.doc_id AND r.chunk_no = c.chunk_no
                WHERE (CASE WHEN told IS NOT NULL THEN {_cut('told', 360)} ELSE quote END) <> ({_cut('c.flat', 360)})
                UNION ALL SELECT a.qid, c.doc_id, c.chunk_no, 3, CASE WHEN told IS NOT NULL THEN {_cut('told', 420)} ELSE quote END FROM scope a JOIN chunk c USING (doc_id) LEFT JOIN spoken s ON s.qid = a.qid AND s.doc_id = c.doc_id AND s.chunk_no = c.chunk_no JOIN ({_readable(420)}) r ON r.doc_id = c.doc_id AND r.chunk_no = c.chunk_no),
     phrase_u AS (SELECT qid, doc_id, chunk_no, kind_no, 'phrase' AS kind, 0 AS nth, 90 AS unit_no, unit, {_support('0.12')} + {_if(_any('lower(section)', 'result', 'experiment', 'abstract', 'conclusion'), '0.06')} AS raw
                  FROM (SELECT u.*, q.* EXCLUDE (qid), c.section, lower(unit) AS low FROM quoted u JOIN q USING (qid) JOIN chunk c ON c.doc_id = u.doc_id AND c.chunk_no = u.chunk_no) WHERE unit <> ''),
     sentence_u AS (SELECT qid, doc_id, chunk_no, 1 AS kind_no, 'sentence' AS kind, row_number() OVER (PARTITION BY qid, doc_id, chunk_no ORDER BY raw DESC, n) - 1 AS nth, n AS unit_no, {_cut('unit', 520)} AS unit, raw
                  FROM (SELECT *, least(1, {_support('0.08')}) AS raw FROM (SELECT *, lower(unit) AS low FROM (SELECT a.*, e.chunk_no, e.n, CASE WHEN length(s) < 90 AND after IS NOT NULL THEN s || ' ' || after ELSE s END AS unit FROM asked a JOIN sentence e USING (doc_id) WHERE length(s) >= 24))) QUALIFY nth < 5),
     row_u AS (SELECT qid, doc_id, chunk_no, 0 AS kind_no, 'table_row' AS kind, row_number() OVER (PARTITION BY qid, doc_id, chunk_no ORDER BY raw DESC, n) - 1 AS nth, n AS unit_no, {_cut('unit', 620)} AS unit, raw
                  FROM (SELECT *, CASE WHEN header <> '' AND NOT contains(r, header) THEN header || ' | ' || r ELSE r END AS unit, round(least(1, 0.58::DOUBLE + hits * 0.08::DOUBLE + least(numbers, 4) * 0.08::DOUBLE + metrics * 0.07::DOUBLE), 9) AS raw
                        FROM (SELECT a.qid, t.*, {_met('lower(t.r)')} AS hits, {_count('lower(t.r)', _UNIT)} AS numbers, {_sum('lower(t.r)', 'accuracy', 'error', 'score', 'metric', 'result', 'auc', 'f1', 'memory', 'parameter', '%')} AS metrics FROM asked a JOIN trow t USING (doc_id) WHERE t.r <> t.header) WHERE hits + numbers + metrics > 0) QUALIFY nth < 3),
     unit AS MATERIALIZED (SELECT *, {_KEY.format('unit')} AS key FROM (SELECT * FROM row_u UNION ALL SELECT * FROM sentence_u UNION ALL SELECT * FROM phrase_u)),
     seen AS (SELECT DISTINCT qid, {_KEY.format('c.text')} AS key FROM cand JOIN clean c USING (doc_id, chunk_no)),
     raised AS (SELECT u.*, p.anchor_no, p.place, round(least(1, raw + least(anchor_score, 1) * CASE kind WHEN 'phrase' THEN 0.28::DOUBLE ELSE 0.18::DOUBLE END + bonus), 9) AS score FROM unit u JOIN place p USING (qid, doc_id, chunk_no) WHERE kind_no < 3 AND (kind_no <> 1 OR nth < 4)),
     ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor_no, doc_id, chunk_no ORDER BY CASE kind WHEN 'phrase' THEN score ELSE raw END DESC, unit_no, kind_no) AS spot FROM raised WHERE key <> ''),
     fresh AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY qid, anchor_no, doc_id, chunk_no, key ORDER BY spot) = 1),
     four AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor_no, doc_id, chunk_no ORDER BY spot) AS fourth FROM fresh WHERE score >= 0.58::DOUBLE QUALIFY fourth <= 4),
     once AS (SELECT * FROM four ANTI JOIN seen USING (qid, key) QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY anchor_no, place, fourth) = 1),
     room AS (SELECT qid, count(*) AS had, count(DISTINCT doc_id) AS docs, greatest(36, count(*)) AS most, least(greatest(36, count(*)), greatest(count(*), floor(greatest(36, count(*)) * 0.65::DOUBLE))) - count(*) AS own FROM cand GROUP BY 1),
     near AS MATERIALIZED (SELECT o.*, row_number() OVER (PARTITION BY qid ORDER BY anchor_no, place, fourth) AS n, own FROM once o JOIN room USING (qid) QUALIFY n <= own),
     spare AS (SELECT r.qid, most - had - coalesce(c, 0) AS spare, greatest(2, least(6, (most - had - coalesce(c, 0)) // docs + 2)) AS cap FROM room r LEFT JOIN (SELECT qid, count(*) AS c FROM near GROUP BY 1) n ON n.qid = r.qid),
     far_a AS (SELECT *, round(least(1, least(1, raw) + words * 0.45::DOUBLE + 0.04::DOUBLE), 9) AS score FROM (SELECT u.*, doc_no, mechanism, CASE WHEN mechanism THEN {_MECHANISM} ELSE 0 END AS words FROM (SELECT *, lower(unit) AS low FROM unit WHERE kind_no <> 2 AND key <> '') u JOIN asked a USING (qid, doc_id))),
     far_b AS (SELECT *, CASE WHEN mechanism THEN words ELSE score END AS priority, CASE kind WHEN 'table_row' THEN 0.03 WHEN 'phrase' THEN 0.02 ELSE 0.01 END AS fine FROM far_a WHERE score >= 0.78::DOUBLE OR words >= 0.14::DOUBLE),
     far_c AS (SELECT * FROM far_b ANTI JOIN seen USING (qid, key) ANTI JOIN near USING (qid, key) QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY doc_no, priority DESC, score DESC, fine DESC, chunk_no, unit_no) = 1),
     far_d AS (SELECT * FROM far_c QUALIFY row_number() OVER (PARTITION BY qid, doc_id, chunk_no ORDER BY priority DESC, score DESC, fine DESC, unit_no) = 1),
     far_e AS (SELECT f.*, spare, cap, row_number() OVER (PARTITION BY qid, doc_id ORDER BY priority DESC, score DESC, fine DESC, chunk_no, unit_no) AS own FROM far_d f JOIN spare USING (qid) WHERE spare > 0 QUALIFY own <= cap),
     far AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_no, own) AS n FROM far_e QUALIFY n <= spare),
     shown AS (SELECT qid, 0 AS phase, rank AS n, doc_id, chunk_no, 'chunk' AS kind, -1 AS unit_no, score, '' AS expanded_from, raw_text AS text FROM cand JOIN clean USING (doc_id, chunk_no)
               UNION ALL SELECT qid, 1, n, doc_id, chunk_no, kind, unit_no, score, 'neighbour', unit FROM near UNION ALL SELECT qid, 2, n, doc_id, chunk_no, kind, unit_no, score, 'document', unit FROM far)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE kind WHEN 'table_row' THEN 0.035 WHEN 'phrase' THEN 0.03 WHEN 'sentence' THEN 0.02 ELSE 0 END DESC, phase, n))::INTEGER AS rank,
       doc_id, chunk_no::INTEGER AS chunk_no, kind, unit_no::INTEGER AS unit_no, score, expanded_from, md5(text) AS text FROM shown""",
}
