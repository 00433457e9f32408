"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from changelore.llm import quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_PLAIN = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
_OPENINGS = "|".join(quality_rules.BOILERPLATE)

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), often AS (
  SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN often USING (doc_id, g), range(0, 8) AS r(k) GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), signed AS (
  SELECT *, regexp_replace(line, '{_PLAIN}', '', 'g') AS signs,
    length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars FROM raw_lines
), judged AS (
  SELECT *, (length(line) >= 20 AND length(signs) * 6 > length(line))
    OR (length(regexp_replace(signs, '[^|»›•·]+', '', 'g')) >= 3
      AND length(regexp_replace(signs, '[^|»›•·]+', '', 'g')) * 40 >= length(line))
    OR (length(line) <= 200 AND regexp_matches(line, '(?i)^[^\p{{L}}]{{0,9}}(?:{_OPENINGS})')) AS bad
  FROM signed
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines,
    CAST(coalesce(sum(chars) FILTER (bad), 0) AS BIGINT) AS lost_chars,
    count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS n_dup_lines
  FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_lines, n_failed_lines, lost_chars
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= {quality_rules.MAX_LOSS} * word_chars AS kept
FROM base"""

EMBEDDING_LSH = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), component AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN component ON component.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""

SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
    greatest(coalesce(CASE WHEN length(text) > 0
      THEN 1 - length(regexp_replace(text, '{_PLAIN}', '', 'g')) / greatest(length(text), 1) END, 0), 0.1) AS q,
    (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT *, -ln(u) / q AS k FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fit AS (
  SELECT level AS fit FROM levels WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(coalesce((SELECT fit FROM fit) * w, cap), cap) AS target FROM weighted
), plan AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1) + 1e-9) AS BIGINT) AS epochs FROM targets
), budget AS (
  SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS budget FROM plan
), summed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS done
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, epochs * size + greatest(least(budget - done, size), 0) AS taken FROM summed"""

PASSAGES = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), firsts AS (
  SELECT g, min(doc_id) AS f FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN firsts USING (g), range(0, 13) AS r(k) WHERE f < doc_id
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) p
  ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos GROUP BY p.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), numbered AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM numbered a JOIN numbered b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, {_ITEM_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), document_windows AS (
  SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)
), hits AS (
  SELECT DISTINCT doc_id, p, n, item_id FROM document_windows JOIN item_windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

# bit by bit over the bytes of an ASCII key
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT *, {_CRC32} % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)
), placed AS (
  SELECT *, coalesce(conv_id, -9223372036854775808) AS c, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
    WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad
  FROM placed
), inserted(state, middle, piece, line, price) AS (
  VALUES (0, 0, '', '', 0), (0, 2, 'I', E'user:\n', 5), (0, 3, 'II', E'user:\nassistant:\n', 10),
    (1, 1, '', '', 0), (1, 2, 'I', E'user:\n', 5), (1, 3, 'II', E'user:\nassistant:\n', 10),
    (2, 2, '', '', 0), (2, 3, 'I', E'assistant:\n', 5), (3, 3, '', '', 0), (3, 2, 'I', E'user:\n', 5)
), edits(middle, wants, after, edit, role, price) AS (
  VALUES (0, '', 0, 'D', '', 2), (1, '', 1, 'D', '', 2), (2, '', 2, 'D', '', 2), (3, '', 3, 'D', '', 2),
    (0, 's', 1, 'K', '', 0), (0, 'u', 2, 'K', '', 0), (1, 'u', 2, 'K', '', 0), (2, 'a', 3, 'K', '', 0), (3, 'u', 2, 'K', '', 0),
    (0, '', 2, 'R', 'user', 1), (1, '', 2, 'R', 'user', 1), (2, '', 3, 'R', 'assistant', 1), (3, '', 2, 'R', 'user', 1)
), walk AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'text': ''}} AS best FROM placed
  UNION ALL
  SELECT w.c, w.i + 1, e.after, min({{
    'cost': w.best.cost + n.price + e.price + CASE WHEN e.edit <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END,
    'audit': w.best.audit || n.piece || e.edit,
    'text': w.best.text || n.line || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10)
      ELSE e.role || ':' || r.text || chr(10) END}})
  FROM walk w JOIN r ON r.c = w.c AND r.i = w.i + 1 JOIN inserted n ON n.state = w.state
    JOIN edits e ON e.middle = n.middle AND e.wants IN ('', r.initial) AND (e.edit = 'D' OR r.fault NOT IN (1, 2))
  GROUP BY w.c, w.i, e.after
), counted AS (
  SELECT c, count(*) AS n, count(DISTINCT turn) AS turns, max(turn) - min(turn) + 1 AS reach, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal
  FROM r GROUP BY c
), ended AS (
  SELECT w.c, min({{'cost': best.cost + n.price, 'audit': best.audit || n.piece, 'text': best.text || n.line}}) AS best
  FROM walk w JOIN counted k ON k.c = w.c AND w.i = k.n JOIN inserted n ON n.state = w.state AND (n.middle = 3 OR n.middle = 0)
  GROUP BY w.c
)
SELECT o.conv_id, CAST(coalesce(reach - turns, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.text, greatest(length(best.text) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted k ON k.c = coalesce(o.conv_id, -9223372036854775808) LEFT JOIN ended e ON e.c = k.c"""

SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), vocabulary AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN vocabulary USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, v.term, coalesce(n, 0)::HUGEINT AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total,
    count(*) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS v
  FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS p FROM dense
), wholes AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, (
    SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 200"""

ORACLES = {
    "op1_quality_rules": QUALITY_RULES,
    "op2_embedding_lsh": EMBEDDING_LSH,
    "op6_source_mix": SOURCE_MIX,
    "op7_passage_automata": PASSAGES,
    "op8_ngram_join": NGRAM_JOIN,
    "op11_benchmark_decontamination": DECONTAMINATION,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_source_divergence": SOURCE_DIVERGENCE,
}
