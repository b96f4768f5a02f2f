"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from prospectra.llm import license_scan

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Documents with the same set of normalised lines count once.
OP2 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, source AS host, {_WORDS} AS w FROM documents),
windows AS (
  SELECT k, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
often AS (SELECT k, win FROM windows GROUP BY k, win HAVING count(*) > 1),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words
  FROM (SELECT k, i, unnest([0, 1, 2, 3, 4]) AS d FROM windows JOIN often USING (k, win)) GROUP BY k),
raw_lines AS (SELECT k, host, unnest(string_split(text, chr(10))) AS raw FROM docs),
worded AS (
  SELECT k, host, raw, regexp_extract_all({_LOWER.replace('text', 'raw')}, '[^\x20\x09-\x0D]+') AS lw FROM raw_lines),
lined AS (SELECT k, host, raw, array_to_string(lw, ' ') AS line, len(lw) AS n FROM worded WHERE len(lw) > 0),
dups AS (SELECT k, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lined GROUP BY k),
lines AS (SELECT k, host, line, sum(n) AS n FROM lined GROUP BY k, host, line),
pages AS (SELECT k, host, string_agg(line, chr(10) ORDER BY line) AS page FROM lines GROUP BY k, host),
sizes AS (
  SELECT host, count(DISTINCT coalesce(page, '')) AS host_docs FROM docs LEFT JOIN (SELECT k, page FROM pages) USING (k) GROUP BY host),
frequent AS (
  SELECT l.host, l.line FROM lines l JOIN pages p USING (k) JOIN sizes s ON l.host IS NOT DISTINCT FROM s.host
  GROUP BY l.host, l.line, s.host_docs
  HAVING count(DISTINCT p.page) > 20 AND (100 * count(DISTINCT p.page) > 5 * s.host_docs OR count(DISTINCT p.page) > 1000)),
removed AS (
  SELECT l.k, sum(l.n) AS removed_words FROM lines l
  JOIN frequent f ON l.line = f.line AND l.host IS NOT DISTINCT FROM f.host GROUP BY l.k),
joined AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN covered USING (k) LEFT JOIN dups USING (k) LEFT JOIN removed USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 100 * (n_words - removed_words) < 30 * n_words AS kept,
  removed_words
FROM joined
"""

OP8 = """
WITH docs AS (SELECT doc_id, text, source, coalesce(length(text), 0) AS chars FROM documents),
sizes AS (SELECT source, sum(chars)::DOUBLE AS size FROM docs GROUP BY source),
raws AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS raw FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN raw / sum(raw) OVER () * sum(size) OVER () / size ELSE 0 END AS rate FROM raws),
draws AS (
  SELECT doc_id, docs.source, chars, rate,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE
      / 4503599627370496.0 AS u
  FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source),
counts AS (
  SELECT doc_id, source, chars, u, list_reduce(
    list_prepend({'k': 0, 'p': exp(-rate), 'c': exp(-rate)},
      list_transform(range(1, 165), lambda i: {'k': i::INTEGER, 'p': rate, 'c': 0.0::DOUBLE})),
    lambda s, i: CASE WHEN u < s.c THEN s ELSE
      {'k': i.k, 'p': s.p * rate / i.k, 'c': s.c + s.p * rate / i.k} END).k AS n
  FROM draws)
SELECT doc_id, source, chars::BIGINT AS chars FROM (
  SELECT doc_id, source, chars, unnest(range(0, n)) AS copy FROM counts WHERE n > 0)
"""

OP5 = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT k, count(*) AS n FROM sets GROUP BY k),
pairs AS (
  SELECT a.k AS a, b.k AS b, count(*) AS met FROM sets a JOIN sets b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
reach(k, other) AS (
  SELECT k, k FROM docs UNION SELECT r.k, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach r JOIN docs d ON d.k = r.k JOIN docs o ON o.k = r.other LEFT JOIN sizes s ON s.k = r.k GROUP BY r.k
"""

# The template's markers: 15 characters around a system text, 13 around a user's, 9 around an assistant's.
OP7 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, lag(turn) OVER w AS turn_before, lag(role) OVER w AS role_before, row_number() OVER w AS place,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(replace(text, '\', '\\'),
      '<<SYS>>|<</SYS>>|\[/INST\]|\[INST\]|\[OUT\]|\[ROLE\]|\[/ROLE\]|\[:\]|</s>|<s>')) AS hidden
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(hidden + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END))::BIGINT
    AS formatted_chars,
  count(*) FILTER (WHERE turn <= turn_before OR NOT CASE coalesce(role_before, '')
    WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE role = 'user' END) AS n_problems
FROM placed GROUP BY conv_id
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"('{p.label}', {_list(p.words())})" for p in license_scan.PHRASES)
_TEMPLATES = ", ".join(
    f"('{t.label}', {_list(t.distinct())}, {_list(t.naming.split())}::VARCHAR[], {len(t.words())}, "
    f"{len(t.distinct()) if len(t.words()) < 10 else -(-len(t.distinct()) * 80 // 100)})" for t in license_scan.TEMPLATES)

OP9 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(label, p) AS (VALUES {_PHRASES}),
templates(label, need, naming, n, least) AS (VALUES {_TEMPLATES}),
spots AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE list_has_any(w, ['license', 'by'])),
places AS (SELECT k, label, i - 1 AS place FROM spots JOIN phrases ON w[i:i + len(p) - 1] = p),
base AS (
  SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY k),
held AS (SELECT k, w, t.* FROM docs JOIN templates t ON len(list_intersect(need, w)) >= least),
blocks AS (SELECT k, w, label, need, naming, n, least, unnest(range(0, len(w))) AS b FROM held),
found AS (
  SELECT k, label, least, len(need) AS size, list_intersect(need, w[b + 1:b + 2 * n]) AS met, naming FROM blocks),
more AS (
  SELECT k, label, max(len(met)::DOUBLE / size) AS share FROM found
  WHERE len(met) >= least AND list_has_all(met, naming) GROUP BY k, label),
best AS (SELECT k, max(share) AS best FROM more GROUP BY k),
named AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM places UNION SELECT k, label FROM more) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN best USING (k) LEFT JOIN named USING (k)
"""

# crc32 of a conversation's decimal id, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: i::BIGINT)),
      lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)))"""

OP11 = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, max(p) AS n FROM turns GROUP BY c),
sized AS (
  SELECT o.c, o.c - o.c % 5 AS base, h, least(h, coalesce(b.n, 0)) AS taken
  FROM (SELECT *, {_CRC} % 9 AS h FROM own) o LEFT JOIN own b ON b.c = o.c - o.c % 5),
rebuilt AS (
  SELECT s.c, p AS d, role, text FROM sized s JOIN turns t ON t.c = s.base AND p <= taken
  UNION ALL SELECT s.c, p - h + taken, role, text FROM sized s JOIN turns t ON t.c = s.c AND p > h),
paths AS (
  SELECT c, d, strlen(text) AS bytes, sha256(list(row(role, text)) OVER w::VARCHAR) AS k,
    coalesce(sha256(list(row(role, text)) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::VARCHAR), '') AS up,
    d = count(*) OVER (PARTITION BY c) AS is_end
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY d)
  UNION ALL SELECT c, 0, 0, '', NULL, c NOT IN (SELECT c FROM rebuilt) FROM sized),
named AS (SELECT c, d, bytes, k, CASE WHEN d = 1 THEN '' ELSE up END AS up, is_end FROM paths),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own_tokens,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256 FROM named GROUP BY d, k),
children AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
leafed AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)),
totals AS (
  SELECT a.d, a.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_tokens)::BIGINT AS saved_tokens
  FROM leafed n JOIN named a ON a.c = n.c AND a.d <= n.d GROUP BY a.d, a.k)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM leafed x JOIN totals USING (d, k) LEFT JOIN nodes p ON p.d = x.d - 1 AND p.k = x.up
"""

OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
uses AS (SELECT k, lang, source, t, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t FROM uses GROUP BY lang, t HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
held AS (SELECT lang, source, t, sum(n) AS n FROM uses JOIN kept USING (lang, t) GROUP BY lang, source, t),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM held GROUP BY lang, source) USING (lang, source)),
shares AS (
  SELECT lang, source, t, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN held USING (lang, source, t)),
overall AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(all_n) + 5 * any_value(v))::HUGEINT AS q
  FROM held JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM held GROUP BY lang) USING (lang) GROUP BY lang, t),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (
  SELECT lang, source, t AS item, (p - q)::BIGINT AS value FROM shares JOIN overall USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r
  FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)
  FROM above)
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2,
    "op5_ngram_join": OP5,
    "op7_chat_format": OP7,
    "op8_mixing": OP8,
    "op9_license_scan": OP9,
    "op11_prefix_trie": OP11,
    "op13_divergence": OP13,
}
