"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM {table}"


OP2 = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1"""

OP3 = f"""WITH RECURSIVE t AS ({_words("documents", "doc_id", SPACED)}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM documents AS d LEFT JOIN n USING (doc_id)"""

OP5 = f"""WITH i AS ({_words("benchmark", "item_id", ALNUM)}), d AS ({_words("documents", "doc_id", ALNUM)}),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda j: array_to_string(w[j:j + least(len(w), 10) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS j, w FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size),
h AS (SELECT doc_id, j, iw.size AS size, item_id FROM dw JOIN iw ON iw.size = dw.size AND array_to_string(w[j:j + dw.size - 1], ' ') = g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS pos FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

_MEASURES = {"symbol_pm": ("n_symbols * 1000", "word_chars", 50), "dup_line_pm": ("n_dup_lines * 1000", "n_lines", 300), "repeat_pm": ("n_repeat_words * 1000", "n_words", 100), "word_len_c": ("word_chars * 100", "n_words", 200)}
_BINS = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {slack} AS slack, {'least(2000, ' if m == 'word_len_c' else '('}floor({a} / greatest({b}, 1))) AS bin FROM b" for m, (a, b, slack) in _MEASURES.items()
)
OP7 = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS g FROM t WHERE len(w) >= 5),
u AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM u) GROUP BY 1),
a AS (SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ln) AS n_lines FROM t LEFT JOIN r ON t.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a),
x AS ({_BINS}),
k AS (SELECT lang, source, measure, slack, bin, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL),
y AS (SELECT 0 AS level, lang, source, measure, slack, bin, n FROM k UNION ALL SELECT 1, lang, NULL, measure, slack, bin, sum(n) FROM k GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, slack, bin, sum(n) FROM k GROUP BY ALL),
z AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM y),
q AS (SELECT level, lang, source, measure, min(bin) FILTER (WHERE upto * 100 >= total * 25) AS q1, min(bin) FILTER (WHERE upto * 100 >= total * 75) AS q3, any_value(slack) AS slack, max(total) AS total FROM z GROUP BY ALL),
f AS (SELECT *, q3 + 3 * (q3 - q1) + slack AS fence, level = 2 OR (total >= 20 AND q3 + 3 * (q3 - q1) + slack < CASE measure WHEN 'word_len_c' THEN 2000 ELSE 1000 END) AS useful FROM q),
v AS (SELECT doc_id, bool_or(bin > coalesce(f0.fence, f1.fence, f2.fence)) AS beyond
  FROM x LEFT JOIN f AS f0 ON f0.level = 0 AND f0.useful AND x.lang IS NOT DISTINCT FROM f0.lang AND x.source IS NOT DISTINCT FROM f0.source AND x.measure = f0.measure
    LEFT JOIN f AS f1 ON f1.level = 1 AND f1.useful AND x.lang IS NOT DISTINCT FROM f1.lang AND x.measure = f1.measure LEFT JOIN f AS f2 ON f2.level = 2 AND x.measure = f2.measure GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM b JOIN v USING (doc_id)"""

OP11 = f"""WITH d AS ({_words("documents", "doc_id", ALNUM)}), i AS ({_words("benchmark", "item_id", ALNUM)}),
c AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM i),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN g USING (term) JOIN f USING (term), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

OP13 = r"""WITH RECURSIVE
b AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
y AS (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(substr(key, j, 1)) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS z FROM y, b),
d AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid FROM d),
p AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
e (edit, st, initial, nx, role, price) AS (VALUES ('D', 0, NULL, 0, NULL, 2), ('D', 1, NULL, 1, NULL, 2), ('D', 2, NULL, 2, NULL, 2), ('D', 3, NULL, 3, NULL, 2), ('K', 0, 's', 1, NULL, 0), ('K', 0, 'u', 2, NULL, 0), ('K', 1, 'u', 2, NULL, 0),
  ('K', 3, 'u', 2, NULL, 0), ('K', 2, 'a', 3, NULL, 0), ('R', 0, NULL, 2, 'user', 1), ('R', 1, NULL, 2, 'user', 1), ('R', 3, NULL, 2, 'user', 1), ('R', 2, NULL, 3, 'assistant', 1)),
n (st, nx, more, said) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
  (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, st, cost, audit, said FROM (
    SELECT r.conv_id, p.i, e.nx AS st, r.cost + 5 * length(n.more) + e.price + CASE WHEN p.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost, r.audit || n.more || e.edit AS audit,
      list_concat(list_concat(r.said, n.said), CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [p.role || ':' || p.text] ELSE [e.role || ':' || p.text] END) AS said
    FROM r JOIN n ON n.st = r.st JOIN e ON e.st = n.nx JOIN p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i + 1
    WHERE e.edit = 'D' OR p.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = p.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY 1),
x AS (SELECT r.conv_id, r.cost + 5 * length(n.more) AS cost, r.audit || n.more AS audit, list_concat(r.said, n.said) AS said, gaps, blank, duplicate, truncated, illegal
  FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id JOIN n ON n.st = r.st AND n.nx IN (0, 3) WHERE r.i = coalesce(g.rows, 0)),
z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM z"""

SQL = {"op2_chat_format": OP2, "op3_ngram_join": OP3, "op5_decontaminate": OP5, "op7_quality_rules": OP7, "op11_ranked_search": OP11, "op13_conversation_repair": OP13}
