"""The PII query in SQL: base spans by regular expressions, disclosing words by joins."""

OP1_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     kind(kind, ord, pattern) AS (VALUES ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
                                         ('card', 2, '[0-9](?:[ -]?[0-9])+'), ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]')),
     cut AS (SELECT doc_id, kind, ord, CASE kind WHEN 'email' THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
                    WHEN 'card' THEN regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+') ELSE regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]') END AS found,
                    CASE kind WHEN 'email' THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
                    WHEN 'card' THEN string_split_regex(text, '[0-9](?:[ -]?[0-9])+') ELSE string_split_regex(text, '\+[0-9][ ().0-9-]+[0-9]') END AS gaps FROM doc, kind),
     hit AS (SELECT doc_id, kind, ord, unnest(found) AS value, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS k FROM cut WHERE len(found) > 0),
     placed AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits, (sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, kind ORDER BY k))::BIGINT AS stop FROM hit),
     valid AS (SELECT doc_id, kind, ord, value, digits, stop - length(value) AS start, stop FROM placed
               WHERE kind = 'email'
                  OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0)
                  OR (kind = 'phone' AND length(digits) BETWEEN 10 AND 15)
                  OR (kind = 'card' AND length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                        CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INT WHEN reverse(digits)[i]::INT * 2 > 9 THEN reverse(digits)[i]::INT * 2 - 9 ELSE reverse(digits)[i]::INT * 2 END)) % 10 = 0)),
     near AS (SELECT md5(text) AS h, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE digits END AS entity,
                     text[greatest(start - 60, 0) + 1:start] AS before, start > 60 AS cut_before, text[stop + 1:stop + 60] AS after, length(text[stop + 1:stop + 60]) = 60 AS cut_after
              FROM valid JOIN doc USING (doc_id)),
     term AS (SELECT DISTINCT h, entity, word FROM (SELECT h, entity, unnest(list_concat(
                  list_transform(regexp_extract_all(' ' || lower(CASE WHEN cut_before THEN regexp_replace(before, '^[^ \x09-\x0D]+', '') ELSE before END), '(?:^|[^\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_]{3,})', 1), lambda w: w),
                  regexp_extract_all(' ' || lower(CASE WHEN cut_after THEN regexp_replace(after, '[^ \x09-\x0D]+$', '') ELSE after END), '(?:^|[^\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_]{3,})', 1))) AS word FROM near)),
     pair AS (SELECT entity, word, count(*) AS both_ FROM term GROUP BY ALL HAVING count(*) >= 3),
     entity AS (SELECT entity, count(DISTINCT h) AS n_entity FROM near GROUP BY 1),
     holds AS (SELECT DISTINCT md5(text) AS h, unnest(regexp_extract_all(' ' || lower(text), '(?:^|[^\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_]{3,})', 1)) AS word FROM doc),
     n_word AS (SELECT word, count(*) AS n_word FROM holds WHERE word IN (SELECT word FROM pair) GROUP BY 1),
     size AS (SELECT greatest(2, count(DISTINCT md5(text))) AS n FROM doc),
     disclosing AS (SELECT word FROM pair JOIN entity USING (entity) JOIN n_word USING (word), size WHERE n > n_entity
                    GROUP BY 1 HAVING max(1 - log2(greatest(n_word, both_) / both_) / log2(n / n_entity)) >= 0.9),
     marked AS (SELECT DISTINCT doc_id FROM doc JOIN holds ON holds.h = md5(text) WHERE word IN (SELECT word FROM disclosing)),
     piece AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS parts FROM doc WHERE doc_id IN (SELECT doc_id FROM marked)),
     token AS (SELECT doc_id, unnest(parts) AS value, generate_subscripts(parts, 1) AS k FROM piece),
     spot AS (SELECT doc_id, value, (sum(length(value)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS stop FROM token),
     free AS (SELECT s.doc_id, s.stop - length(s.value) AS start, s.stop FROM spot s WHERE lower(s.value) IN (SELECT word FROM disclosing)
              AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.doc_id = s.doc_id AND v.start < s.stop AND s.stop - length(s.value) < v.stop)),
     share AS (SELECT word, max(1 - log2(greatest(n_word, both_) / both_) / log2(n / n_entity)) AS share FROM pair JOIN entity USING (entity) JOIN n_word USING (word), size WHERE n > n_entity GROUP BY 1),
     every AS (SELECT doc_id, start, stop, ord, kind FROM valid
               UNION ALL SELECT s.doc_id, f.start, f.stop, 4, CASE WHEN sh.share >= 0.97 THEN 'removed' ELSE 'term' END FROM free f JOIN spot s ON s.doc_id = f.doc_id AND s.stop = f.stop JOIN share sh ON sh.word = lower(s.value))
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind IS NOT NULL), '') AS spans, count(*) FILTER (ord = 4) AS n_term
FROM doc d LEFT JOIN every e USING (doc_id) GROUP BY d.doc_id
"""
