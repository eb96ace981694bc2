"""SQL for DuckDB that gives the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

from quern.llm import license_scan, quality_rules
from quern.llm._common import BLANKS, LOWER, UPPER, WORD_SEPARATORS

TEXT = "coalesce(text, '')"
ASCII_LOWER = f"translate({TEXT}, '{UPPER}', '{LOWER}')"
ALNUM = f"list_filter(string_split_regex({ASCII_LOWER}, '{WORD_SEPARATORS}'), lambda x: x <> '')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANKS}'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""WITH h AS (SELECT doc_id, hex(encode({TEXT})) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM h WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
k AS (SELECT doc_id, i FROM g JOIN m USING (s) WHERE m < doc_id),
r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM k),
q AS (SELECT doc_id, i, sum((d IS NULL OR d > 50)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans FROM c JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)"""

OP2 = f"""WITH u AS (SELECT text, row_number() OVER () AS u FROM (SELECT DISTINCT {TEXT} AS text FROM documents)),
l AS (SELECT u, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT u, string_split(text, chr(10)) AS ls FROM u)),
t AS (SELECT *, {_words("line")} AS t FROM l),
x AS (SELECT u, line, i, t, CASE WHEN len(t) >= 4 THEN len(t) || ' ' || regexp_replace(array_to_string(t[1:8], ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') WHEN len(t) > 0 THEN len(t) || ' ' || array_to_string(t, ' ') END AS path FROM t),
c AS (SELECT DISTINCT u, array_to_string(t[k:k + 7], ' ') AS c FROM (SELECT u, t, unnest(list_filter(range(1, len(t) + 1), lambda i: i = 1 OR (unicode(t[i]) + 3 * length(t[i])) % 8 = 0)) AS k FROM t WHERE len(t) > 0)),
m AS (SELECT c FROM c GROUP BY c HAVING count(*) >= 5),
n AS (SELECT u, unnest([1, 2]) AS e, unnest([low, high]) AS sign FROM (SELECT u, min(c) FILTER (c IN (SELECT c FROM m)) AS low, max(c) FILTER (c IN (SELECT c FROM m)) AS high FROM c GROUP BY u HAVING count_if(c NOT IN (SELECT c FROM m)) * 8 < count(*))),
s AS (SELECT e, c, sign, count(*) AS n FROM c JOIN n USING (u) WHERE c IN (SELECT sign FROM n) GROUP BY ALL),
o AS (SELECT e, c AS sign, max_by(sign, n) AS other FROM s GROUP BY e, c HAVING 2 * max(n) > sum(n)),
near AS (SELECT u, e, coalesce(other, sign) AS near FROM n LEFT JOIN o USING (e, sign)),
d AS (SELECT u, list_sort(list(DISTINCT path)) AS ps FROM x WHERE path IS NOT NULL GROUP BY u),
e AS (SELECT DISTINCT coalesce(e, 0) AS e, CASE WHEN near IS NULL THEN ps ELSE [near] END AS context, unnest(ps) AS path FROM d LEFT JOIN near USING (u)),
bad AS (SELECT path FROM e GROUP BY path HAVING count_if(e = 0) + greatest(count_if(e = 1), count_if(e = 2)) >= 5),
k AS (SELECT x.*, bad.path IS NOT NULL AS drop FROM x LEFT JOIN bad USING (path)),
g AS (SELECT u, count(*) AS n_lines, count_if(drop)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '') AS kept FROM k GROUP BY u)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM documents JOIN u ON u.text = {TEXT.replace("text", "documents.text")} JOIN g USING (u)"""

OP3 = f"""WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS key, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, n, item_id FROM s JOIN bw USING (key, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OWN = "'\\### Assistant: </turn> ok'"
_ESCAPED = "length(replace(replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c'))"
OP5 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_OWN} UNION ALL SELECT -7, 1, 'assistant', {_OWN}),
s AS (SELECT *, last_value(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
v AS (SELECT *, CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'assistant' THEN role IN ('user', 'tool') ELSE role IN ('assistant', 'tool') END AS ok FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(14 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars,
count_if(NOT ok) = 0 AND coalesce(last(role ORDER BY turn, role, text) FILTER (role IN ('system', 'user', 'assistant', 'tool')), '') = 'assistant' AS valid, count_if(NOT ok)::BIGINT AS n_violations
FROM v GROUP BY conv_id"""


def _license_sql() -> str:
    own = ", ".join(f"('{label}', '{w}', {i})" for label, (text, _) in license_scan.TEMPLATES.items() for i, w in enumerate(license_scan.template_words(text)))
    musts = ", ".join(f"('{label}', '{p}')" for label, (_, ps) in license_scan.TEMPLATES.items() for p in ps)
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_scan.BASE.items())
    return f"""WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
b(phrase, label, n) AS (VALUES {base}), tw(label, word, pos) AS (VALUES {own}), m(label, phrase) AS (VALUES {musts}),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
wt AS (SELECT word, df, floor(1000 * ln(((SELECT count(*) FROM d) + 1) / df))::BIGINT + 1 AS wt FROM df),
lw AS (SELECT label, word, min(pos) AS first FROM tw GROUP BY label, word),
lim AS (SELECT label, least(8, (count(DISTINCT word) + 1) // 2) AS least, greatest(1, count(*) // 10) AS slack FROM tw GROUP BY label),
o AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' ') = phrase)) AS place FROM j, b WHERE contains(s, ' ' || phrase || ' ')),
ob AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM o GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM j),
al AS (SELECT doc_id, lim.label FROM j, lim WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.label = lim.label AND NOT contains(s, ' ' || m.phrase || ' '))),
dw AS (SELECT DISTINCT doc_id, word FROM t WHERE word IN (SELECT word FROM tw)),
c AS (SELECT doc_id, label, word, wt FROM al JOIN lw USING (label) JOIN dw USING (doc_id, word) JOIN wt USING (word) QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY df, first) <= 8),
tot AS (SELECT doc_id, label, sum(wt) AS total, any_value(slack) AS slack FROM c JOIN lim USING (label) GROUP BY doc_id, label HAVING count(*) >= any_value(least)),
h AS (SELECT DISTINCT doc_id, label, word, wt, total, floor((place - pos) / slack)::BIGINT - back AS step FROM tot JOIN c USING (doc_id, label) JOIN t USING (doc_id, word) JOIN tw USING (label, word), (VALUES (0), (1)) k(back)),
u AS (SELECT doc_id, label, sum(wt) / any_value(total) AS share FROM h GROUP BY doc_id, label, step),
x AS (SELECT doc_id, max(share) AS share, list_sort(list(DISTINCT label) FILTER (share >= 0.75)) AS found FROM u GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, coalesce(array_to_string(found, ','), '') AS template_labels
FROM d LEFT JOIN ob USING (doc_id) LEFT JOIN x USING (doc_id)"""


def _quality_sql() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda chars, text: f"(length({text}) - length(translate({text}, {chars}, '')))"
    nav, boiler = _quoted(quality_rules.NAVIGATION), _quoted(quality_rules.BOILERPLATE)
    symbols, separators = _quoted(quality_rules.SYMBOLS), _quoted(quality_rules.SEPARATORS)
    return f"""WITH d AS (SELECT doc_id, {TEXT} AS text FROM documents), w AS (SELECT doc_id, text, {_words("text")} AS w FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
n AS (SELECT doc_id, line, i, trim(line, {blank}) AS body, len({_words("line")}) AS n, coalesce(trim(lead(line) OVER (PARTITION BY doc_id ORDER BY i), {blank}), '') AS following FROM l),
f AS (SELECT doc_id, line, i, n, length(translate(line, {blank}, '')) AS chars,
  {count(symbols, "body")} * 10 > 3 * length(body) OR n >= 5 AND {count("'!'", "body")} * 2 > n AND body = upper(body)
  OR n >= 12 AND NOT contains({_quoted(quality_rules.ENDINGS)}, right(body, 1)) AND NOT regexp_matches(following, {_quoted(quality_rules.GOES_ON)})
  OR {count(separators, "body")} * 4 >= n + 4 OR n <= 20 AND regexp_matches(body, {nav}) OR n <= 20 AND regexp_matches(body, {boiler}) AS fails FROM n WHERE n > 0),
g AS (SELECT doc_id, count(*) AS n_lines, count_if(fails)::BIGINT AS n_removed_lines, sum(chars) FILTER (fails) AS lost, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
z AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM z) WHERE c > 1),
q AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(w) AS n_words, length(translate(text, {blank}, '')) AS word_chars, {count(symbols, "text")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost, 0) AS lost FROM w LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars AS kept, n_lines, n_removed_lines FROM a"""


OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(ASCII_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(w.doc_id, coalesce(min(y), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id"""

OP12 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
x AS (SELECT count(*) AS n_docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
t AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, x GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, r, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score FROM t JOIN q USING (term) JOIN f USING (term), x GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op2_line_dedup": OP2,
    "op3_decontamination": OP3,
    "op5_chat_format": OP5,
    "op6_license_scan": _license_sql(),
    "op8_quality_rules": _quality_sql(),
    "op10_ngram_join": OP10,
    "op12_lexical_search": OP12,
}
