"""SQL twins of the registered queries (DuckDB). Regular expressions here are RE2: no look-around."""

from __future__ import annotations

from .functions import fixed

_STOP = ", ".join(f"'{w}'" for w in fixed.PHRASE_STOP)


def _hits(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


def _plain(text: str) -> str:
    """Dashes, soft hyphens, ligatures and line hyphens."""
    out = f"translate({text}, '{fixed.DASHES}{fixed.SOFT_HYPHEN}', '{'-' * len(fixed.DASHES)}')"
    for ligature, letters in fixed.LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    return rf"regexp_replace({out}, '([A-Za-z])-[\s]+([A-Za-z])', '\1\2', 'g')"


def _clean(text: str) -> str:
    out = rf"regexp_replace({_plain(text)}, '[\p{{L}}\p{{N}}_.\-+]+@[\p{{L}}\p{{N}}_.\-]+\.[\p{{L}}\p{{N}}_]+', '{fixed.HIDDEN_EMAIL}', 'g')"
    for label in fixed.MASKED_LABELS:
        out = rf"regexp_replace({out}, '({label})\s*[:：]\s*\S+', '\1：{fixed.HIDDEN}', 'g')"
    return out


def _flat(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_CHARS = "一-鿿"
_LOW = _flat(f"lower({_clean('text')})")
_TABLE = rf"""(length(flat) > 0 AND ({_count('flat', r'\|')} >= 6
    OR len(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '' AND (contains(x, '|') OR contains(x, chr(9))))) / greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''))) >= 0.35
    OR ({_count('flat', '[0-9]')} / length(flat) > 0.28 AND {_count('flat', f'[{_CHARS}]')} < 80 AND length(flat) > 100)
    OR ({_count('flat', r'[|,:：/\\]')} / length(flat) > 0.22 AND length(flat) > 120)))"""
_FLAT_TABLE = rf"""(length(flat) > 0 AND ({_count('flat', r'\|')} >= 6 OR contains(flat, '|')
    OR ({_count('flat', '[0-9]')} / length(flat) > 0.28 AND {_count('flat', f'[{_CHARS}]')} < 80 AND length(flat) > 100)
    OR ({_count('flat', r'[|,:：/\\]')} / length(flat) > 0.22 AND length(flat) > 120)))"""
_STORE_TABLE = rf"(length(flat) > 0 AND ({_count('flat', r'\|')} >= 6 OR ({_count('flat', '[0-9]')} / length(flat) > 0.28 AND {_count('flat', f'[{_CHARS}]')} < 80 AND length(flat) > 100)))"
_TOKENS = f"""list_filter(flatten(list_transform(regexp_extract_all(lower({{}}), '[a-z0-9]{{{{2,}}}}|[{_CHARS}]{{{{2,}}}}'), lambda r: CASE WHEN NOT regexp_matches(r, '^[{_CHARS}]') THEN [r]
    ELSE list_concat(CASE WHEN length(r) <= 4 THEN [r] ELSE [] END, list_transform(range(1, length(r)), lambda i: r[i:i + 1]), CASE WHEN length(r) >= 4 THEN list_transform(range(1, length(r) - 1), lambda i: r[i:i + 2]) ELSE [] END) END)),
    lambda t: t NOT IN ({', '.join(f"'{w}'" for w in fixed.TOKEN_BLOCKED)}))"""

#: Postings, question terms and BM25 over documents: post, n, qterm, raw.
_POST = f"""post AS (SELECT token, doc_id, count(*) AS tf, any_value(dl) AS dl FROM
        (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM (SELECT doc_id, {_TOKENS.format(_clean('text'))} AS toks FROM documents)) GROUP BY token, doc_id)"""
_PHRASES = rf"""word AS (SELECT item_id AS qid, list_filter(regexp_extract_all({_LOW}, '[a-z0-9][a-z0-9\-]*'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS ws FROM benchmark),
     shingle AS (SELECT qid, size, i, ws[i:i + size - 1] AS run FROM word, unnest([4, 3, 2]) AS s(size), unnest(range(1, len(ws) + 1)) AS p(i) WHERE i + size - 1 <= len(ws)),
     phrase AS (SELECT qid, min((-size, i)) AS spot, phrase FROM
        (SELECT *, replace(array_to_string(run, ' '), '-', ' ') AS phrase FROM shingle WHERE len(list_filter(run, lambda w: length(w) >= 5)) > 0) WHERE length(phrase) >= 5 GROUP BY qid, phrase),
     kept AS (SELECT qid, phrase, row_number() OVER (PARTITION BY qid ORDER BY spot) - 1 AS n FROM phrase QUALIFY n < 18)"""
_KEYWORDS = """kw AS (SELECT qid, token, min(p) AS p FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), 1) AS p FROM benchmark) GROUP BY ALL),
     keyword AS (SELECT qid, token, row_number() OVER (PARTITION BY qid ORDER BY p) AS n FROM kw QUALIFY n <= 40)"""
_TERMS = f"""{_PHRASES}, {_KEYWORDS},
     listed AS (SELECT qid, 0 AS part, n, token AS term FROM keyword UNION ALL SELECT qid, 1, n, phrase FROM kept),
     every AS (SELECT qid, part, n, unnest(regexp_extract_all(term, '[a-z0-9]{{2,}}')) AS token, generate_subscripts(regexp_extract_all(term, '[a-z0-9]{{2,}}'), 1) AS j FROM listed),
     placed AS (SELECT qid, token, row_number() OVER (PARTITION BY qid ORDER BY part, n, j) AS p FROM every),
     nth AS (SELECT qid, token, p, row_number() OVER (PARTITION BY qid, token ORDER BY p) AS k FROM placed QUALIFY k <= 3),
     capped AS (SELECT qid, token, row_number() OVER (PARTITION BY qid ORDER BY p) AS spot FROM nth QUALIFY spot <= 80),
     qterm AS (SELECT qid, token, count(*) AS qtf FROM capped GROUP BY ALL)"""
_BM25 = f"""{_POST}, {_TERMS},
     size AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT doc_id, any_value(dl) AS dl FROM post GROUP BY 1)),
     df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
     raw AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(mean, 1)))), 6) AS raw
             FROM post JOIN qterm USING (token) JOIN df USING (token), size GROUP BY ALL HAVING raw > 0),
     bm AS (SELECT qid, doc_id, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc_id) AS rank FROM raw QUALIFY rank <= 24)"""


def _vectors(name: str, key: str, source: str) -> str:
    hex_ = lambda at, n: " + ".join(f"(strpos('0123456789abcdef', md5(token)[{at + i}]) - 1) * {16 ** (n - 1 - i)}::BIGINT" for i in range(n))
    return f"""{name}_t AS (SELECT {key}, unnest(CASE WHEN len(toks) > 0 THEN toks WHEN length(text) > 0 THEN [text[:64]] ELSE ['empty'] END) AS token FROM (SELECT {key}, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}') AS toks FROM {source})),
     {name}_s AS (SELECT {key}, ({hex_(1, 8)}) % 384 AS bucket, sum(CASE WHEN ({hex_(9, 2)}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_t GROUP BY ALL HAVING x <> 0),
     {name} AS (SELECT {key}, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS weight FROM {name}_s)"""


_DENSE = f"""{_vectors('dv', 'doc_id', 'documents')}, {_vectors('qv', 'qid', '(SELECT item_id AS qid, text FROM benchmark)')},
     cosine AS (SELECT qid, doc_id, round(greatest(0, sum(d.weight * q.weight)), 6) AS score FROM dv d JOIN qv q USING (bucket) GROUP BY ALL),
     dn AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM cosine QUALIFY rank <= 24)"""
_RRF = f"""{_BM25}, {_DENSE},
     lists AS (SELECT qid, 0 AS list_no, rank, doc_id, score, score AS vector_score, NULL::DOUBLE AS sparse_score FROM dn
               UNION ALL SELECT qid, 1, rank, doc_id, round(raw / (raw + 3), 6), NULL, round(raw / (raw + 3), 6) FROM bm),
     fused AS (SELECT qid, doc_id, sum(1 / (60.0::DOUBLE + rank)) AS s, min((list_no, rank)) AS seen, max(score) AS own, max(vector_score) AS vector_score, max(sparse_score) AS sparse_score FROM lists GROUP BY ALL),
     rrf AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, seen) AS rank, vector_score, sparse_score, least(1, s / max(s) OVER (PARTITION BY qid)) AS rrf_score, own FROM fused),
     hybrid AS (SELECT qid, doc_id, rank, vector_score, sparse_score, round(rrf_score, 6) AS rrf_score, round(greatest(own, rrf_score), 6) AS score FROM rrf WHERE rank <= 24)"""
#: Question and expansion as questions 2 * qid and 2 * qid + 1 of their own.
_ASKED = f"""asked AS MATERIALIZED (WITH {_PHRASES}, six AS (SELECT qid, string_agg(phrase, ' ' ORDER BY n) AS ps FROM kept WHERE n < 6 GROUP BY 1), own AS (SELECT item_id AS qid, {_flat('text')} AS q FROM benchmark)
     SELECT 2 * qid AS item_id, q AS text FROM own UNION ALL SELECT 2 * qid + 1, q || ' ' || ps FROM own JOIN six USING (qid))"""
_BALANCED = f"""{_ASKED}, {_POST}, {_TERMS.replace('FROM benchmark', 'FROM asked')}, {_vectors('dv', 'doc_id', 'documents')}, {_vectors('qv', 'qid', '(SELECT item_id AS qid, text FROM asked)')},
     home AS (SELECT doc_id, coalesce(source, '') AS source FROM documents), held AS (SELECT * FROM post JOIN home USING (doc_id)),
     size AS (SELECT source, count(*) AS n, avg(dl) AS mean FROM (SELECT source, doc_id, any_value(dl) AS dl FROM held GROUP BY ALL) GROUP BY 1),
     df AS (SELECT token, source, count(*) AS df FROM held GROUP BY ALL),
     raw AS (SELECT qid, source, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(mean, 1)))), 6) AS raw
             FROM held JOIN qterm USING (token) JOIN df USING (token, source) JOIN size USING (source) GROUP BY ALL HAVING raw > 0),
     bm AS (SELECT *, round(raw / (raw + 3), 6) AS score, row_number() OVER (PARTITION BY qid, source ORDER BY raw DESC, doc_id) AS rank FROM raw QUALIFY rank <= 20),
     cosine AS (SELECT qid, source, doc_id, round(greatest(0, sum(d.weight * q.weight)), 6) AS score FROM dv d JOIN qv q USING (bucket) JOIN home USING (doc_id) GROUP BY ALL),
     dn AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS rank FROM cosine QUALIFY rank <= 20),
     lists AS (SELECT qid // 2 AS qid, source, doc_id, qid % 2 * 3 + 1 AS list_no, CASE qid % 2 WHEN 0 THEN 1 ELSE 0.82::DOUBLE END AS weight, rank, score, score AS vector_score, NULL::DOUBLE AS sparse_score FROM dn
               UNION ALL SELECT qid // 2, source, doc_id, qid % 2 * 3 + 2, CASE qid % 2 WHEN 0 THEN 1 ELSE 0.82::DOUBLE END, rank, score, NULL, score FROM bm),
     own_f AS (SELECT qid, source, doc_id, sum(weight / (60.0::DOUBLE + rank)) AS s, min((list_no, rank)) AS seen, max(score) AS own, max(vector_score) AS vector_score, max(sparse_score) AS sparse_score FROM lists GROUP BY ALL),
     own_r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(s, 12) DESC, seen) AS place, greatest(own, s / max(s) OVER (PARTITION BY qid, source)) AS score FROM own_f),
     best AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(score, 9) DESC, place) AS nth FROM own_r WHERE place <= 16 QUALIFY nth <= 4),
     scoped AS (SELECT source, row_number() OVER (ORDER BY source) AS nth FROM (SELECT DISTINCT source FROM home)),
     many AS (SELECT count(*) AS docs FROM scoped),
     all_lists AS (SELECT qid, source, doc_id, 0 AS list_no, 1.35::DOUBLE AS weight, row_number() OVER (PARTITION BY qid ORDER BY source, nth) AS rank, score, vector_score, sparse_score FROM best
               UNION ALL SELECT qid, source, doc_id, list_no + 1 + (nth - 1) * 6, weight, rank, score, vector_score, sparse_score FROM lists JOIN scoped USING (source)),
     fused AS (SELECT qid, source, doc_id, sum(weight / (60.0::DOUBLE + rank)) AS s, min((list_no, rank)) AS seen, max(score) AS own, max(vector_score) AS vector_score, max(sparse_score) AS sparse_score FROM all_lists GROUP BY ALL),
     rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, seen) AS pos, least(1, s / max(s) OVER (PARTITION BY qid)) AS rrf_score FROM fused),
     kept_rows AS (SELECT r.*, round(greatest(own, rrf_score), 9) AS final FROM rrf r, many WHERE pos <= greatest(40, docs * 4)),
     capped_rows AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY final DESC, pos) AS nth FROM kept_rows QUALIFY nth <= (SELECT greatest(2, greatest(20, docs * 2) // greatest(docs, 1) + 1) FROM many)),
     chosen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nth <> 1, final DESC, pos) AS rank FROM capped_rows QUALIFY rank <= (SELECT greatest(20, docs * 2) FROM many))"""
_GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_JUDGED = f"""{_RRF},
     words AS (SELECT qid, list(token) AS ks FROM keyword GROUP BY 1), phrases AS (SELECT qid, list(phrase) AS ps FROM kept GROUP BY 1),
     doc AS (SELECT doc_id, text, {_LOW} AS low, {_flat(_clean('text'))} AS flat FROM documents),
     found AS (SELECT h.*, d.flat, d.text, len(list_filter(coalesce(ks, []), lambda k: contains(low, k))) / greatest(1, len(coalesce(ks, []))) AS exact,
                      len(list_filter(coalesce(ps, []), lambda p: contains(replace(low, '-', ' '), p))) / greatest(1, least(6, len(coalesce(ps, [])))) AS ph
               FROM hybrid h JOIN doc d USING (doc_id) LEFT JOIN words USING (qid) LEFT JOIN phrases USING (qid)),
     judged AS (SELECT *, round(greatest(0, least(1, exact * 0.55::DOUBLE + ph * 0.3::DOUBLE)), 6) AS relevance FROM found)"""
_TOKEN_COUNT = rf"(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda w: ceil(length(w) / 4))), 0) + length(regexp_replace(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*|\s+', '', 'g')))::BIGINT"

def _any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_TRACE = f"""{_JUDGED}, marked AS (SELECT qid, doc_id, rank, score, relevance, {_TABLE} AS table_like FROM judged),
     open AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM marked WHERE NOT table_like),
     picked AS (SELECT qid, doc_id, place AS selected_rank FROM open WHERE place <= 8),
     traced AS (SELECT m.*, p.selected_rank, min(CASE WHEN p.selected_rank IS NOT NULL THEN score END) OVER (PARTITION BY m.qid) AS lowest FROM marked m LEFT JOIN picked p USING (qid, doc_id)),
     trace AS (SELECT qid, doc_id, rank::INTEGER AS rank, selected_rank::INTEGER AS selected_rank, CASE WHEN selected_rank IS NOT NULL THEN 'selected' ELSE 'filtered' END AS status,
                      CASE WHEN selected_rank IS NOT NULL THEN '' WHEN table_like THEN 'table' WHEN relevance < 0.08 AND score < 0.45 THEN 'low_scores' WHEN rank > 8 AND score < lowest THEN 'below_selected' ELSE 'displaced' END AS reason FROM traced)"""
_ROLES = [("purpose", fixed.STRONG_MARKERS), ("claim", ["result", "evaluation", "tion the"]), ("dataset", ["dataset", "data", "|"])]
_ROLE_CASES = " UNION ALL ".join(f"SELECT doc_id, '{role}' AS role, {_hits('low', terms)} * 0.35::DOUBLE + {0.35 if role == 'claim' else 0.0}::DOUBLE + {'CASE WHEN n <= greatest(2, floor(total * 0.08)) THEN 0.35::DOUBLE ELSE 0 END' if role == 'purpose' else 'CASE WHEN table_like THEN 0.25::DOUBLE ELSE 0 END' if role == 'claim' else '0'} AS score FROM marked" for role, terms in _ROLES)


def _rx(text: str, words: str) -> str:
    return f"regexp_matches({text}, '{words}')"


_TABLE_ASKED = "评分表|实验评分|分数构成|分数|总分|表格中|表中|结构化数据|数据是多少|指标|数值|公式|计算"
_FIELDS = {"keywords": "关键词|关键字|keywords|keyword|key words", "abstract": "摘要|abstract", "authors": "作者", "affiliation": "作者单位|单位|机构", "date": "完成日期|日期|时间", "title": "标题|题目"}
_IS_FIELD = "(fields <> '' AND NOT " + _rx("low", "分析|解释|意思|含义|评价|判断|为什么|有必要|必要吗|需要吗|该不该|干扰|怎么|如何|可靠|局限|不足|贡献|方法|结论|风险|治理|支撑|匹配|相符|跑题|概括|总结|摘要一下") + " AND (" + _rx("low", "是什么|有哪些|哪些|列出|提取|写出|给我|告诉我|是多少|是谁|字段|部分|内容|keyword") + " OR length({}) <= 28))"
_CONTENT = "(flat <> '' AND NOT " + _IS_FIELD.format("flat") + " AND " + _rx("flat", "介绍|说说|讲讲|讲一下|说一下|看一下|简单说|简单讲|大概|概括|总结|讲了什么|写了什么|写了啥|是干嘛|做什么|干什么") + " AND " + _rx("flat", "文章|论文|文档|报告|材料|这篇|这份|全文|内容|实验|章节|部分") + ")"
_SUBMITS = "提交|交什么|作业|思考题|选做|评分|交报告|交代码"
_FLAGS = {
    "visual": "(" + _rx("flat", r"图片|截图|图表|图中|图里|图上|图示|架构图|示意图|视觉证据|图片证据|看图|figure|fig\.|chart|diagram|screenshot|visual evidence|image evidence|what does the image|(in|from) the image") + " OR (" + _rx("flat", "图像|视觉|image|visual") + " AND NOT (" + _rx("flat", "图像[-/与和]?文本|图文|image[- /]text|image and text") + " AND " + _rx("flat", "数据|规模|训练|对|data|training|pair") + ")))",
    "table": _rx("low", _TABLE_ASKED),
    "reference": "(" + _rx("low", "参考文献|引用文献|引用了哪些|参考了哪些|用了哪些文献|用了哪些参考|文献列表|参考列表|references|bibliography") + " OR (contains(low, '文献') AND " + _rx("low", "哪些|列出|引用|参考|出处|来源") + "))",
    "field": _IS_FIELD.format("stripped"),
    "compare": _rx("low", "对比|比较|不同点|差异|区别|有什么不同|哪里不同|compare|comparison|different|differences|versus| vs "),
    "overview": "(" + _rx("low", "概括|总结|讲了什么|讲啥|写了啥|写的啥|说了啥|主要内容|通俗语言|大意|一句话") + f" OR {_CONTENT})",
    "document_wide": "(" + _rx("low", "概括|总结|讲了什么|讲啥|讲了啥|写了啥|写的啥|说了啥|大概讲|大概说|主要内容|主要写|通俗语言|大意|一句话|发现|重点|核心|结论|贡献|方法|局限|不足|目的|主题|能学到|学到什么|收获|启发") + f" OR {_CONTENT})",
    "meta": _rx("low", "你是谁|怎么使用|有哪些功能|如何上传|支持什么模型"),
    "opening": _rx("low", "概括|总结|讲了什么|讲啥|讲了啥|写了啥|写的啥|说了啥|主要内容|大意|一句话|目的|主题|能学到|学到什么|收获|启发"),
    "experiment": "(contains(low, '实验') AND " + _rx("low", "内容|目的|要求|步骤|过程|任务|介绍|说说|讲讲|概括|总结|做什么|干什么|是干嘛") + " AND NOT " + _rx("low", _SUBMITS) + ")",
    "topics": _rx("low", "选题|多篇|多份|几篇|这些文献|全部文献|所有文献|同时纳入|一起分析|综合|归纳|综述|文献综述|研究现状|共同|关系|关联|互相|异同|脉络"),
    "metric": _rx("low", "结果|result|table|表格|指标|metric|score|accuracy|error|benchmark"),
    "dataset": _rx("low", "数据集|训练数据|数据规模|规模|dataset|corpus|training set|data scale|samples|多少|构建"),
    "pretraining": "(" + _rx("low", "预训练目标|pre-?training objective") + " OR (" + _rx("low", "预训练|pre-?training") + " AND " + _rx("low", "目标|objective|goal|loss|task") + "))",
    "framework": "(" + _rx("low", "framework|框架|model|system|method") + " AND " + _rx("low", "功能|function|作用|角色|role|component|stage") + ")",
    "trustworthy": "(" + _rx("low", "可信|trustworthy") + " AND " + _rx("low", "特征|特点|characteristic") + ")",
    "mechanism": _rx("plain", "how|why|pursue|achieve|improve|approach|method|mechanism|compare|如何|怎么|怎样|机制|方法|对比"),
    "efficiency": _rx("low", r"(^|[^\p{L}\p{N}_])(efficiency|efficient|resource|memory|parameter|parameters|compute|storage|throughput|latency|speedup|faster|smaller|cost)($|[^\p{L}\p{N}_])"),
    "adaptation": "(" + _rx("low", "main idea|core idea|method idea|adaptation idea|approach|mechanism") + " AND " + _rx("low", "adaptation|fine-tuning|pre-?trained|weights|rank|matrix|matrices|parameter") + ")",
    "factors": "(" + _rx("low", "design|training|factor|ablation|component") + " AND " + _rx("low", "important|identify|affect|effect|representation") + ")",
    "asks_code": _rx("low", "代码|源码|函数|类|实现细节|怎么实现|程序|写法"),
    "asks_submission": _rx("low", _SUBMITS),
}
_MARKED = rf"""texts AS MATERIALIZED (SELECT doc_id, text AS own, {_clean('text')} AS text FROM documents), flats AS MATERIALIZED (SELECT *, {_flat('text')} AS flat, {_flat('lower(text)')} AS low FROM texts),
     kinds AS MATERIALIZED (SELECT *, {_TABLE} AS table_like, {_flat('own')} AS own_flat, {_hits('low', ['论文题目', '题目', '作者', '单位', '学院', '学校', '专业', '班级', '姓名', '学号', '指导教师', '完成日期', '日期', '关键词', '关键字'])} AS labels,
        list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS ls,
        length(regexp_extract(flat, '^(.*?)(?:关键词|关键字|作者|单位|作者单位|机构|日期|完成日期)\s*[:：]', 1)) AS spot,
        len(list_intersect(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), ['function', 'functions', 'core', 'component', 'components', 'capability', 'capabilities', 'stage', 'process', 'role', 'policy', 'strategy'])) AS words,
        {_count('text', 'function |const |let |var |=>|addEventListener|querySelector|return |class |</|[{}]|;')} AS marks FROM flats),
     tested AS (SELECT *, low = '' OR (NOT {_rx('low', 'abstract|introduction|we propose|in this work')} AND ({_rx('low', 'provided proper attribution|hereby grants permission|journalistic or scholarly works|work performed while at|conference on neural information processing systems|arxiv:')}
          OR (labels >= 2 AND length(low) <= 360 AND NOT {_rx('low', '本文围绕|本文旨在|本文提出|本研究|研究认为|in this paper|in this work')}) OR {_rx('low', '^(摘 *要|abstract)[:：]?$')}
          OR ({_rx('low', '作者|单位|日期')} AND {_rx('low', '摘 ?要')} AND NOT {_rx('low', '本文围绕|研究认为|in this paper|in this work')} AND length(low) <= 260)
          OR (length(low) - length(replace(low, '[邮箱已隐藏]', ''))) / 7 >= 3)) AS front_matter,
        flat = '' OR ({_rx('flat', '(关键词|关键字|作者|单位|机构|日期) *[:：]')} AND (spot <= 90 OR length(flat) <= 220)) OR (contains(flat, '摘 要') AND length(flat) <= 80) AS metadata,
        {_rx('flat', '实验提交|提交代码|提交报告|思考题|选做|作业提交|评分标准|可添加公式')} AS submission,
        marks >= 8 OR (words < 3 AND len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, 'function\s+\w+|const\s+\w+|let\s+\w+|var\s+\w+|=>|[{{}};]{{2,}}|</?\w+'))) / len(ls) >= 0.45) AS code,
        regexp_matches(own_flat, '(?i)(^|[^\p{{L}}\p{{N}}_])references($|[^\p{{L}}\p{{N}}_])') OR (contains(own_flat, '参考文献') AND regexp_matches(own_flat, '\[[0-9]{{1,3}}\]')) AS refs FROM kinds),
     penalised AS MATERIALIZED (SELECT *, round(front_matter::INT * 1.8::DOUBLE + metadata::INT * 1.0::DOUBLE + refs::INT * 1.45::DOUBLE + submission::INT * 0.7::DOUBLE + code::INT * 0.55::DOUBLE + table_like::INT * 0.45::DOUBLE, 6) AS penalty FROM tested)"""

#: Role scores of a document by itself, and what noise excludes it from roles.
_ALONE = _ROLE_CASES.replace("n <= greatest(2, floor(total * 0.08))", "TRUE").replace("FROM marked", "FROM alone_d")
_STRUCTURE = f"least(0.8::DOUBLE, {_hits('low', fixed.STRONG_MARKERS)} * 0.22::DOUBLE + {_hits('low', fixed.MEDIUM_MARKERS)} * 0.08::DOUBLE)"
_ALONE_D = f"alone_d AS (SELECT doc_id, text, low, {_TABLE} AS table_like FROM (SELECT doc_id, text, {_LOW} AS low, {_flat('text')} AS flat FROM documents)), alone AS (SELECT * FROM ({_ALONE}) WHERE score > 0)"

_FEATURES = rf"""q AS (SELECT conv_id, turn, lower(text) AS low, {_flat('lower(text)')} AS flat, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS stripped, lower({_clean('text')}) AS plain,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {_rx('lower(text)', w)} THEN '{k}' ELSE '' END" for k, w in _FIELDS.items())}], lambda x: x <> ''), ',') AS fields FROM conversations WHERE role = 'user'),
     f AS (SELECT conv_id, turn, fields, {', '.join(f'coalesce({v}, FALSE) AS "{k}"' for k, v in _FLAGS.items())} FROM q),
     g AS (SELECT *, CASE WHEN reference THEN 'reference_question' WHEN field THEN 'field_lookup_question' WHEN compare THEN 'compare_question' WHEN document_wide THEN 'document_wide_question' WHEN meta THEN 'meta_question' ELSE 'specific_question' END AS intent FROM f)"""

SQL = {
    "plan_records": f"""WITH {_FEATURES},
     asked AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z]{{2,}}')[1:7] AS words, (conv_id + turn) % 6 AS form FROM conversations WHERE role = 'user'),
     own AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'compare_question' WHEN 1 THEN 'document_wide_question' END AS named, list_reduce(words, lambda l, x: CASE WHEN list_contains(l, x) OR len(l) >= 4 THEN l ELSE list_append(l, x) END, []::VARCHAR[]) AS listed FROM asked),
     kw AS (SELECT conv_id, turn, list_reduce(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda l, x: CASE WHEN list_contains(l, x) OR len(l) >= 4 THEN l ELSE list_append(l, x) END, []::VARCHAR[]) AS local_focus FROM asked),
     joined AS (SELECT o.*, g.intent AS own_intent, k.local_focus, form < 3 AS supplied FROM own o JOIN g USING (conv_id, turn) JOIN kw k USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN supplied AND named IS NOT NULL THEN named ELSE own_intent END AS intent,
       CASE WHEN supplied THEN 'judge' ELSE CASE own_intent WHEN 'field_lookup_question' THEN 'extract' WHEN 'reference_question' THEN 'extract' WHEN 'compare_question' THEN 'compare' WHEN 'document_wide_question' THEN 'summarize' ELSE 'answer' END END AS operation,
       CASE WHEN supplied AND turn % 4 = 0 THEN 'field' ELSE CASE own_intent WHEN 'field_lookup_question' THEN 'field' WHEN 'reference_question' THEN 'section' WHEN 'compare_question' THEN 'multi_document' WHEN 'document_wide_question' THEN 'whole_document' ELSE 'specific_point' END END AS scope,
       array_to_string(CASE WHEN supplied AND len(listed) > 0 THEN [x[1:40] FOR x IN listed] WHEN supplied THEN local_focus ELSE local_focus END, ',') AS focus,
       CASE own_intent WHEN 'field_lookup_question' THEN 'field' WHEN 'reference_question' THEN 'reference' ELSE 'purpose,approach,claim,conclusion' END AS preferred_roles,
       round(CASE WHEN supplied THEN greatest(0, least(1, (conv_id % 30) / 10.0::DOUBLE - 0.5::DOUBLE)) ELSE 0.52::DOUBLE END, 6) AS confidence,
       md5(CASE WHEN supplied THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')[1:180] ELSE '' END) AS reason, CASE WHEN supplied THEN 'supplied' ELSE 'local' END AS source
FROM joined""",
    "role_overview": f"""WITH {_MARKED}, doc AS (SELECT doc_id, coalesce(source, '') AS source, text, {_flat('text')} AS flat, {_LOW} AS low, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS total FROM documents),
     marked AS (SELECT *, {_TABLE} AS table_like FROM doc), {_ALONE_D},
     quiet AS (SELECT doc_id FROM penalised WHERE NOT front_matter AND NOT code AND NOT submission AND NOT (refs AND {_count('own', r'\[[0-9]{1,3}\]')} >= 2) AND own_flat <> ''),
     s AS (SELECT d.source, r.doc_id, role, round(r.score, 6) AS score FROM ({_ROLE_CASES}) r JOIN doc d USING (doc_id) SEMI JOIN quiet q ON q.doc_id = r.doc_id WHERE r.score > 0),
     covers AS (SELECT doc_id, list(role) AS roles FROM alone WHERE round(score, 6) >= 0.45 GROUP BY 1),
     best AS (SELECT s.*, coalesce(c.roles, []) AS roles, CASE role WHEN 'purpose' THEN 0 WHEN 'dataset' THEN 1 ELSE 2 END AS place FROM s LEFT JOIN covers c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source, role ORDER BY score DESC, doc_id) = 1),
     chosen AS (SELECT source, list_reduce(list({{'role': role, 'doc_id': doc_id, 'roles': roles}} ORDER BY place),
                  lambda a, x: CASE WHEN list_contains(a.covered, x.role) OR list_contains(a.ids, x.doc_id) OR len(a.ids) >= 4 THEN a
                               ELSE {{'ids': list_append(a.ids, x.doc_id), 'names': list_append(a.names, x.role), 'covered': list_concat(a.covered, x.roles)}} END,
                  {{'ids': []::BIGINT[], 'names': []::VARCHAR[], 'covered': []::VARCHAR[]}}) AS c FROM best GROUP BY 1),
     flat_c AS (SELECT source, unnest(c.ids) AS doc_id, unnest(c.names) AS role, generate_subscripts(c.ids, 1) - 1 AS place FROM chosen)
SELECT source, place::INTEGER AS place, role, doc_id, round(0.98::DOUBLE - 0.05::DOUBLE * place, 6) AS score FROM flat_c""",
    "diverse_overview": f"""WITH {_JUDGED}, {_MARKED.replace('texts AS MATERIALIZED', 'm_texts AS MATERIALIZED').replace('FROM texts)', 'FROM m_texts)')}, {_ALONE_D},
     given AS (SELECT j.qid, j.doc_id, j.rank AS pos, p.front_matter, p.refs, p.own_flat <> '' AND NOT p.front_matter AND NOT p.refs AND NOT p.submission AS usable,
                      j.score * 0.25::DOUBLE + j.relevance * 0.35::DOUBLE + {_STRUCTURE.replace('contains(low,', 'contains(p.low,')} * 0.25::DOUBLE AS bonus FROM judged j JOIN penalised p USING (doc_id)),
     scored AS (SELECT qid, doc_id, pos, role, round(a.score + bonus, 9) AS value FROM given JOIN alone a USING (doc_id) WHERE usable),
     p1 AS (SELECT qid, doc_id, 0 AS place, role FROM scored WHERE role = 'purpose' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY value DESC, pos) = 1),
     p2 AS (SELECT qid, doc_id, 1 AS place, role FROM scored s WHERE role = 'claim' AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM p1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY value DESC, pos) = 1),
     p3 AS (SELECT qid, doc_id, 2 AS place, role FROM scored s WHERE role = 'dataset' AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM p1 UNION ALL SELECT (qid, doc_id) FROM p2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY value DESC, pos) = 1),
     taken AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
     every_row AS (SELECT g.*, place, role, max((place IS NOT NULL OR (NOT front_matter AND NOT refs))::INT) OVER (PARTITION BY g.qid) AS any_open FROM given g LEFT JOIN taken t ON t.qid = g.qid AND t.doc_id = g.doc_id)
SELECT qid, doc_id, (row_number() OVER (PARTITION BY qid ORDER BY place IS NULL, place, pos))::INTEGER AS rank, coalesce(role, '') AS role FROM every_row
WHERE place IS NOT NULL OR (NOT front_matter AND NOT refs) OR any_open = 0 QUALIFY rank <= 8""",
    "question_features": f"""WITH {_FEATURES}
SELECT *, CASE intent WHEN 'reference_question' THEN 'reference_section' WHEN 'field_lookup_question' THEN 'field_lookup' WHEN 'compare_question' THEN 'comparison_overview' WHEN 'document_wide_question' THEN 'document_overview' WHEN 'meta_question' THEN 'no_retrieval' ELSE 'vector_similarity' END AS strategy FROM g""",
    "noise_penalties": f"WITH {_MARKED} SELECT doc_id, front_matter, metadata, submission, code, penalty FROM penalised",
    "boosted_bm25_top5": f"""WITH {_MARKED}, quiet AS (SELECT doc_id, own AS text FROM penalised WHERE penalty < 2.2), {_BM25.replace('AS toks FROM documents)', 'AS toks FROM quiet)')},
     d AS (SELECT doc_id, own AS text, own_flat AS flat, low, lower(text) AS lowtext FROM penalised WHERE penalty < 2.2), r AS (SELECT *, {_TABLE} AS as_table FROM d),
     focus AS (SELECT qid, list(token) AS fs FROM keyword WHERE n <= 4 GROUP BY 1),
     s AS (SELECT raw.qid, raw.doc_id, round(raw + 0.8::DOUBLE * ({_hits('low', ['result', 'evaluation', 'tion the'])} * 0.35::DOUBLE + CASE WHEN as_table THEN 0.25 ELSE 0 END) - CASE WHEN as_table AND NOT {_rx('lower(b.text)', _TABLE_ASKED)} THEN 1.1::DOUBLE ELSE 0 END
             + 0.55::DOUBLE * coalesce(len(list_filter(fs, lambda t: contains(lowtext, t))) / len(fs), 0), 6) AS raw FROM raw JOIN r USING (doc_id) JOIN benchmark b ON b.item_id = raw.qid LEFT JOIN focus USING (qid)),
     t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc_id) AS rank FROM s QUALIFY rank <= 5)
SELECT qid, rank::INTEGER AS rank, doc_id, round(CASE WHEN raw <= 0 THEN 0 ELSE raw / (raw + 3) END, 6) AS score FROM t""",
    "store_quotes": rf"""WITH d AS (SELECT doc_id, {_flat('text')} AS flat FROM documents),
     e AS (SELECT doc_id, unnest(parts) AS flat, generate_subscripts(parts, 1) AS n FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(flat, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM d)),
     p AS (SELECT doc_id, n, flat, sum(length(flat)) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM e WHERE NOT {_STORE_TABLE}),
     q AS (SELECT doc_id, string_agg(flat, '' ORDER BY n) AS quote FROM p WHERE upto <= 280 GROUP BY 1)
SELECT doc_id, md5(CASE WHEN length(flat) <= 280 AND NOT {_STORE_TABLE} THEN flat ELSE coalesce(quote, flat[:280]) END) AS quote FROM d LEFT JOIN q USING (doc_id)""",
    "targeted_rules": rf"""WITH {_JUDGED}, c AS (SELECT qid, doc_id, relevance, {_clean('text')} AS text FROM judged), e AS (SELECT *, lower(text) AS low, {_flat('text')} AS flat FROM c),
     w AS (SELECT *, {_TABLE} AS table_like, len(list_filter(['function', 'functions', 'core', 'component', 'components', 'capability', 'capabilities', 'stage', 'stages', 'process', 'processes', 'role', 'roles', 'policy', 'strategy', 'outcome', 'outcomes'], lambda x: regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])' || x || '($|[^\p{{L}}\p{{N}}_])'))) AS words FROM e),
     a AS (SELECT qid, doc_id, 1 AS rule_no, 'framework' AS rule, round(0.72::DOUBLE + least(0.22::DOUBLE, words * 0.04::DOUBLE) + CASE WHEN {_rx('low', 'core|function|component|categories')} THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN {_rx('low', 'composed of|consists of|organized into|functions organize')} THEN 0.24::DOUBLE ELSE 0 END + 0.25::DOUBLE * relevance, 6) AS s FROM w WHERE words >= 2
           UNION ALL SELECT qid, doc_id, 2, 'table', round(0.85::DOUBLE + 0.5::DOUBLE * relevance, 6) FROM w WHERE table_like),
     k AS (SELECT *, row_number() OVER (PARTITION BY qid, rule_no ORDER BY s DESC, doc_id) AS rank FROM a QUALIFY rank <= 5),
     o AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rule_no, rank) AS once FROM k QUALIFY once = 1)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY rule_no, rank))::INTEGER AS position, rule, doc_id, least(1, s) AS score FROM o""",
    "target_documents": f"""WITH {_RRF}, {_GOLD}, c AS (SELECT h.qid, h.doc_id, g.doc_id IS NOT NULL AS asked FROM hybrid h LEFT JOIN gold g ON g.qid = h.qid AND g.doc_id = h.doc_id)
SELECT qid, doc_id FROM c QUALIFY asked OR NOT bool_or(asked) OVER (PARTITION BY qid)""",
    "gold_scores": f"""WITH {_RRF}, {_GOLD}, e AS (SELECT qid, doc_id, rank FROM hybrid WHERE rank <= 5), n AS (SELECT qid, count(*) AS n FROM e GROUP BY 1),
     m AS (SELECT g.qid, count(*) AS n_gold, count(e.doc_id) AS n_met, bool_or(coalesce(e.rank = 1, FALSE)) AS first FROM gold g LEFT JOIN e ON e.qid = g.qid AND e.doc_id = g.doc_id GROUP BY 1),
     p AS (SELECT qid, list(phrase) AS ps FROM kept WHERE n < 3 GROUP BY 1),
     x AS (SELECT item_id AS qid, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'There is not enough evidence.' ELSE text || ' [E1]' END AS answer, regexp_matches(lower(text), '证据不足|无法证明|没有证据|无关结论|unsupported|not enough evidence') AS refusal, coalesce(n.n, 0) AS n, n_gold, n_met, first, ps FROM benchmark LEFT JOIN n ON n.qid = item_id LEFT JOIN m ON m.qid = item_id LEFT JOIN p ON p.qid = item_id),
     f AS (SELECT *, {_flat('lower(' + _plain('answer') + ')')} AS form, item_id5 FROM (SELECT *, qid % 5 AS item_id5 FROM x)),
     c AS (SELECT qid, answer, list_filter([CASE WHEN n = 0 THEN 'no_evidence' ELSE '' END, CASE WHEN item_id5 < 2 OR n = 0 THEN 'citation_missing' ELSE '' END, CASE WHEN n < 2 THEN 'wrong_document' ELSE '' END,
         CASE WHEN n_gold > 0 AND n_met / n_gold < 0.5 THEN 'gold_evidence_missed' ELSE '' END, CASE WHEN n_gold > 0 AND NOT (item_id5 > 1 AND first) THEN 'citation_unsupported' ELSE '' END,
         CASE WHEN len(ps) > 0 AND len(list_filter(ps, lambda t: contains(form, t))) / len(ps) < 0.67 THEN 'answer_point_missing' ELSE '' END, CASE WHEN refusal AND NOT regexp_matches(form, 'not enough evidence|cannot determine|does not support|no evidence') THEN 'refusal_missing' ELSE '' END], lambda x: x <> '') AS fs FROM f)
SELECT qid, CASE WHEN answer IS NULL THEN 'blocked' WHEN len(fs) = 0 THEN 'pass' ELSE 'fail' END AS status, round(CASE WHEN answer IS NULL THEN 0 ELSE 1 - len(fs) / 9 END, 6) AS score, CASE WHEN answer IS NULL THEN 'answer_generation_failure' ELSE array_to_string(fs, ',') END AS failures FROM c""",
    "document_upsert": "SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value, min(event_id) AS created, max(event_id) AS updated FROM events GROUP BY 1",
    "conversation_list": r"SELECT conv_id, coalesce(nullif(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '^\s+|\s+$', '', 'g')[:40], ''), '新的论文对话') AS title, count(*) AS n_messages FROM conversations GROUP BY 1",
    "role_totals": f"""WITH doc AS (SELECT doc_id, source, text, {_flat('text')} AS flat, {_LOW} AS low, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS total FROM documents),
     marked AS (SELECT *, {_TABLE} AS table_like FROM doc), s AS (SELECT doc_id, role, round(score, 6) AS score FROM ({_ROLE_CASES}) WHERE score > 0),
     t AS (SELECT source, role, round(sum(score), 3) AS score FROM s JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY score DESC, role))::INTEGER AS place, role, score FROM t""",
    "query_expansion": f"""WITH {_PHRASES}, six AS (SELECT qid, string_agg(phrase, ' ' ORDER BY n) AS ps FROM kept WHERE n < 6 GROUP BY 1),
     own AS (SELECT item_id AS qid, {_flat('text')} AS q FROM benchmark)
SELECT qid, 0::BIGINT AS query_no, md5(q) AS query FROM own UNION ALL SELECT qid, 1, md5(q || ' ' || ps) FROM own JOIN six USING (qid)""",
    "role_scores": f"""WITH doc AS (SELECT doc_id, source, text, {_flat('text')} AS flat, {_LOW} AS low, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS total FROM documents),
     marked AS (SELECT *, {_TABLE} AS table_like FROM doc)
SELECT doc_id, role, round(score, 6) AS score FROM ({_ROLE_CASES}) WHERE score > 0""",
    "key_terms": f"""WITH t AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS p FROM (SELECT doc_id, {_TOKENS.format(_clean('text'))} AS toks FROM documents)),
     c AS (SELECT doc_id, token, count(*) AS count, min(p) AS first FROM t WHERE length(token) >= 3 GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first))::INTEGER AS n, token, count FROM c QUALIFY n <= 8""",
    "selection_trace": f"WITH {_TRACE} SELECT * REPLACE (coalesce(selected_rank, 0) AS selected_rank) FROM trace",
    "trace_summary": f"WITH {_TRACE} SELECT qid, count(*) AS n_candidates, count(*) FILTER (status = 'selected') AS n_selected, count(*) FILTER (reason = 'table') AS \"table\", count(*) FILTER (reason = 'below_selected') AS below_selected, count(*) FILTER (reason = 'displaced') AS displaced FROM trace GROUP BY 1",
    "best_quotes": rf"""WITH {_BM25}, top AS (SELECT qid, doc_id FROM bm WHERE rank <= 5), words AS (SELECT qid, list(token) AS ks FROM keyword GROUP BY 1),
     s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents WHERE doc_id IN (SELECT doc_id FROM top)),
     e AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS n FROM s),
     m AS (SELECT t.qid, t.doc_id, n, sentence, len(list_filter(ks, lambda k: contains(lower(sentence), k))) AS met FROM top t JOIN words USING (qid) JOIN e ON e.doc_id = t.doc_id),
     b AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY met DESC, n) AS place FROM m WHERE met > 0 QUALIFY place <= 2)
SELECT qid, doc_id, md5(string_agg(sentence, ' ' ORDER BY n)) AS quote FROM b GROUP BY ALL""",
    "opening_documents": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "truncated": rf"""WITH d AS (SELECT doc_id, {_flat('text')} AS flat FROM documents), h AS (SELECT *, flat[:220] AS head FROM d),
     m AS (SELECT *, list_max(list_transform(['。', '！', '？', '.', ';', ' '], lambda c: CASE WHEN contains(head, c) THEN 220 - strpos(reverse(head), c) ELSE -1 END)) AS spot FROM h)
SELECT doc_id, CASE WHEN length(flat) <= 220 THEN flat ELSE regexp_replace(flat[:CASE WHEN spot < 121 THEN 220 ELSE spot END], '[ ,，;；.]+$', '') || '...' END AS head FROM m""",
    "content_hash": "SELECT doc_id, sha256(text) AS file_hash, strlen(text)::INTEGER AS n_bytes FROM documents WHERE length(text) > 0 AND strlen(text) <= 83886080",
    "ingest_dedup": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "replace_documents": "SELECT doc_id, length(text)::INTEGER AS n, 'stored' AS version FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT page_id, length(html)::INTEGER, 'new' FROM pages",
    "store_counts": "SELECT lang, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    "catalog": "SELECT d.doc_id, lang, source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) = 1",
    "sanitized": f"SELECT doc_id, sha256(clean) AS clean_sha, contains(clean, '{fixed.HIDDEN_EMAIL}') AS masked FROM (SELECT doc_id, {_clean('text')} AS clean FROM documents)",
    "chunk_features": rf"""
WITH doc AS (SELECT doc_id, text, {_flat('text')} AS flat, {_LOW} AS low FROM documents),
     marked AS (SELECT *, {_TABLE} AS table_like, {_FLAT_TABLE} AS flat_table FROM doc)
SELECT doc_id, table_like, (length(flat) > 0 AND ({_count('flat', r'\|')} >= 6 OR ({_count('flat', '[0-9]')} / length(flat) > 0.28 AND {_count('flat', f'[{_CHARS}]')} < 80 AND length(flat) > 100))) AS store_table_like,
       round(CASE WHEN flat = '' THEN 0 ELSE least(1, greatest(0, 0.2::DOUBLE + CASE WHEN {_count('flat', f'[{_CHARS}]')} >= 30 OR {_count('flat', '[A-Za-z]')} >= 30 THEN 0.25 ELSE 0 END
         + CASE WHEN regexp_matches(flat, '[。！？.!?；;]') THEN 0.2 ELSE 0 END + CASE WHEN length(flat) BETWEEN 80 AND 1200 THEN 0.15 ELSE 0 END - CASE WHEN flat_table THEN 0.35 ELSE 0 END
         - CASE WHEN contains(flat, '姓名') OR contains(flat, '学号') OR contains(flat, '电子邮件') OR contains(flat, '邮箱') THEN 0.15 ELSE 0 END)) END, 6) AS readability,
       round(least(0.8::DOUBLE, {_hits('low', fixed.STRONG_MARKERS)} * 0.22::DOUBLE + {_hits('low', fixed.MEDIUM_MARKERS)} * 0.08::DOUBLE), 6) AS overview,
       {_count('text', r'\[[0-9]{1,3}\]')}::BIGINT AS markers, ({' + '.join(f"contains(text, '{k}')::INT * {w}" for k, w in fixed.RELIABILITY.items())})::BIGINT AS reliability
FROM marked""",
    "token_counts": f"SELECT doc_id, {_TOKEN_COUNT} AS n_tokens FROM documents",
    "chunk_strategy": rf"""
WITH s AS (SELECT doc_id, text, {_TOKEN_COUNT} AS token_count,
                  len(list_filter(string_split_regex(regexp_replace(text, '([。.])\s+', '\1' || chr(1), 'g'), '\x01|\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS paragraph_count,
                  {_count('text', f'[{_CHARS}]')} AS cjk, {_count('text', '[A-Za-z]')} AS latin,
                  ({_count('text', r'[α-ωΑ-Ω=+\-*/<>≤≥∑∫√]|p\s*[<=>]')} + 2 * {_count('text', r'(?i)\b(?:table|表)\s*[0-9]+|\|')}) / greatest(1, length(text)) AS ratio FROM documents),
     t AS (SELECT *, CASE WHEN cjk > latin * 1.5 THEN 'zh' WHEN latin > cjk * 1.5 THEN 'en' ELSE 'mixed' END AS language, token_count >= 70000 AS long_, token_count <= 18000 AS short_,
                  paragraph_count >= 18 AS dense, paragraph_count <= 5 AND token_count > 900 AS sparse FROM s),
     u AS (SELECT *, CASE WHEN long_ THEN 950 WHEN short_ THEN 520 ELSE 720 END AS c, CASE WHEN long_ THEN 140 WHEN short_ THEN 70 ELSE 90 END AS o, CASE WHEN long_ THEN 1800 WHEN short_ THEN 1050 ELSE 1350 END AS p,
                  CASE WHEN long_ THEN 220 WHEN short_ THEN 120 ELSE 160 END AS po FROM t),
     v AS (SELECT *, CASE WHEN dense THEN greatest(460, c - 120) WHEN sparse THEN c + 120 ELSE c END AS c2, CASE WHEN dense THEN greatest(60, o - 20) WHEN sparse THEN o + 35 ELSE o END AS o2,
                  CASE WHEN NOT dense AND sparse THEN p + 180 ELSE p END AS p2 FROM u),
     w AS (SELECT *, CASE WHEN language = 'zh' THEN floor(c2 * 0.9) ELSE c2 END AS c3, CASE WHEN language = 'zh' THEN floor(o2 * 0.9) ELSE o2 END AS o3, CASE WHEN language = 'zh' THEN floor(p2 * 0.9) ELSE p2 END AS p3 FROM v)
SELECT doc_id, token_count, paragraph_count::BIGINT AS paragraph_count, language, c3::INT AS chunk_size, (CASE WHEN ratio > 0.012 THEN greatest(o3, 130) ELSE o3 END)::INT AS overlap, p3::INT AS parent_chunk_size,
       (CASE WHEN ratio > 0.012 THEN greatest(po, 220) ELSE po END)::INT AS parent_overlap, CASE WHEN ratio > 0.012 THEN 'layout-aware-token-page-hybrid' ELSE 'token-paragraph-cross-page-hybrid' END AS splitter FROM w""",
    "sentence_list": r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, i::BIGINT AS n, md5(part) AS sentence FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM s)""",
    "turn_context": "SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), lag(text) OVER w, text, lead(text) OVER w)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "search_tokens": f"SELECT doc_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens FROM (SELECT doc_id, {_TOKENS.format(_clean('text'))} AS toks FROM documents)",
    "question_phrases": f"WITH {_PHRASES} SELECT qid, n, phrase FROM kept",
    "term_statistics": f"WITH {_POST} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1",
    "bm25_top5": f"WITH {_BM25} SELECT qid, rank::INTEGER AS rank, doc_id, round(raw / (raw + 3), 6) AS score FROM bm WHERE rank <= 5",
    "hash_vectors": f"WITH {_vectors('dv', 'doc_id', 'documents')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM dv",
    "hash_dense_top5": f"WITH {_DENSE} SELECT qid, rank::INTEGER AS rank, doc_id, score FROM dn WHERE rank <= 5",
    "dense_top5": """
WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS item_id, greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
           FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.embedding IS NOT NULL AND e.embedding IS NOT NULL AND e.vec_id IS NOT NULL)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id))::INTEGER AS rank, item_id, round(score, 5) AS score FROM s QUALIFY rank <= 5""",
    "hybrid_rrf": f"WITH {_RRF} SELECT qid, doc_id, rank::INTEGER AS rank, vector_score, sparse_score, rrf_score, score FROM hybrid",
    "balanced_hybrid": f"WITH {_BALANCED} SELECT qid, source, doc_id, rank::INTEGER AS rank, vector_score, sparse_score, round(rrf_score, 6) AS rrf_score, round(final, 6) AS score FROM chosen",
    "balanced_selection": f"""WITH {_RRF},
     r AS (SELECT h.qid, d.source, h.doc_id, h.score, h.rank AS pos, row_number() OVER (PARTITION BY h.qid, d.source ORDER BY h.score DESC, h.rank) AS own FROM hybrid h JOIN documents d USING (doc_id)),
     c AS (SELECT qid, count(DISTINCT source) AS docs FROM r GROUP BY 1)
SELECT qid, source, doc_id, (row_number() OVER (PARTITION BY qid ORDER BY own <> 1, score DESC, pos))::INTEGER AS rank FROM r JOIN c USING (qid) WHERE own <= greatest(2, 8 // docs + 1) QUALIFY rank <= 8""",
    "numbered_evidence": f"WITH {_RRF} SELECT qid, doc_id, 'E' || rank AS citation_id FROM hybrid WHERE rank <= 5",
    "relevance_scores": f"WITH {_JUDGED} SELECT qid, doc_id, relevance FROM judged",
    "verdicts": f"""WITH {_JUDGED}, t AS (SELECT qid, doc_id, score, relevance, {_TABLE} AS table_like FROM judged)
SELECT qid, doc_id, CASE WHEN table_like THEN 'reject' WHEN relevance >= 0.24 OR score >= 0.82 THEN 'direct' WHEN relevance >= 0.08 OR score >= 0.45 THEN 'supporting' ELSE 'background' END AS verdict,
       round(round_even(CASE WHEN table_like THEN 0.7::DOUBLE WHEN relevance >= 0.24 OR score >= 0.82 THEN least(0.9, 0.58 + relevance) WHEN relevance >= 0.08 OR score >= 0.45 THEN 0.62 ELSE 0.45 END, 3), 2) AS confidence FROM t""",
    "evidence_quality": f"""WITH {_JUDGED}
SELECT qid, count(*) AS n, CASE WHEN max(score) >= 0.7 OR max(relevance) >= 0.25 THEN 'strong' WHEN max(score) >= 0.45 OR max(relevance) >= 0.12 THEN 'medium' ELSE 'weak' END AS quality FROM judged GROUP BY 1""",
    "source_cards": f"""WITH {_RRF}, e AS (SELECT DISTINCT h.qid, d.lang FROM hybrid h JOIN documents d USING (doc_id) WHERE h.rank <= 5),
     c AS (SELECT item_id AS qid, l.lang, e.lang IS NOT NULL AS covered FROM benchmark CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang) l LEFT JOIN e ON e.qid = item_id AND e.lang = l.lang)
SELECT qid, count(*) FILTER (covered) AS n_covered, round(count(*) FILTER (covered) / count(*), 3) AS ratio, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (NOT covered), '') AS missing FROM c GROUP BY 1""",
    "answer_checks": f"""WITH {_RRF}, e AS (SELECT qid, count(*) AS n FROM hybrid WHERE rank <= 5 GROUP BY 1)
SELECT item_id AS qid, 3 AS n_cited, array_to_string(list_filter(['E1', 'E3', 'E9'], lambda c: c[2:]::INT > coalesce(n, 0)), ',') AS missing, 'fail' AS status FROM benchmark LEFT JOIN e ON qid = item_id""",
    "planted_gold": f"WITH {_GOLD} SELECT qid, doc_id FROM gold",
    "gold_recall": f"WITH {_BM25}, {_GOLD} SELECT g.qid, count(*) AS n_gold, round(count(b.doc_id) / count(*), 6) AS recall FROM gold g LEFT JOIN bm b ON b.qid = g.qid AND b.doc_id = g.doc_id AND b.rank <= 5 GROUP BY 1",
    "evaluation_forms": rf"SELECT doc_id, md5({_flat('lower(form)')}) AS form FROM (SELECT doc_id, regexp_replace(regexp_replace({_plain('text')}, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g') AS form FROM documents)",
    "run_roll_up": "SELECT coalesce(lang, 'all') AS lang, coalesce(toxic::VARCHAR, 'all') AS toxic, count(*) AS n_cases, count(*) FILTER (quality = 1) AS n_passed, round(avg(n_chars), 4) AS avg_n_chars FROM (SELECT lang, toxic, quality, n_chars FROM labels JOIN documents USING (doc_id)) AS labels_documents GROUP BY CUBE (labels_documents.lang, labels_documents.toxic)",
    "message_counts": "SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY 1",
    "recent_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "summary_points": "SELECT user_id AS conv_id, unnest(range(40, count(*) + 1, 30))::INTEGER AS at FROM events GROUP BY 1 HAVING count(*) >= 40",
    "memory_upsert": """SELECT user_id AS conv_id, event_type AS memory_type, round(arg_max(value, event_id), 4) AS value, round(max(greatest(0, least(1, value / 100))), 6) AS confidence,
       max(CASE WHEN event_id % 3 <> 0 THEN event_id END) AS source_message_id, min(event_id) AS created_seq, max(event_id) AS updated_seq FROM events GROUP BY ALL""",
    "run_metrics": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "uncovered_documents": f"WITH {_BM25} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bm)",
}
