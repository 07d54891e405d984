"""SQL of the queries that SQL can express, for another engine."""

from __future__ import annotations

from fleetlens.llm import quality

_BITS = " + ".join(f"CASE WHEN {r.sql} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))

_LEDGER = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), words AS (
  SELECT doc_id, rid, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), grams AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS c
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits,
         length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals,
         len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}}) *$'))) AS n_ellipsis_lines
  FROM words LEFT JOIN covered USING (rid)
), b AS (SELECT *, CAST({_BITS} AS BIGINT) AS rule_bits FROM m)
"""
OP9 = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       rule_bits = 0 AS kept, rule_bits
FROM b
"""

_PLACE = {r.name: i for i, r in enumerate(quality.RULES)}
_CASES = ", ".join(
    f"('{policy}', '{rule}', {sum(2 ** _PLACE[r] for r in names)}, {2 ** _PLACE[rule]})" for policy, names in quality.POLICIES.items() for rule in names
)
ABLATIONS = _LEDGER + f"""
SELECT policy, rule, count(*) AS n_docs, CAST(count_if(rule_bits & one <> 0) AS BIGINT) AS n_failed,
       CAST(count_if(rule_bits & whole = 0) AS BIGINT) AS n_kept, CAST(count_if(rule_bits & whole = one) AS BIGINT) AS n_only
FROM b CROSS JOIN (VALUES {_CASES}) AS cases(policy, rule, whole, one)
GROUP BY policy, rule
"""

_REACH = """
reach AS (
  SELECT id, id AS other FROM ids
  UNION
  SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a
)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND array_cosine_similarity(x.e, y.e) >= 0.95
), ids AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = id OR b = id) AS BIGINT) AS n_links,
       min(other) AS component_id, min(other) = id AS kept
FROM reach GROUP BY id
"""

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = id AS kept
FROM reach LEFT JOIN sizes ON doc_id = id GROUP BY id
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), w AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS winner FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM w
"""

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"

OP8 = rf"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         make_timestamp((1704067200 + (page_id * 7919) % 43200 * 60) * 1000000) AS moment FROM pages
), log AS (
  SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN 'allow' ELSE 'block' END AS list,
         CASE WHEN event_type = 'error' THEN host || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/]+)/', 1) || '/'
              WHEN event_type = 'view' THEN regexp_replace(host, '^(m|blog)\.', '') ELSE host END AS pattern,
         ts, bool_or(event_type NOT IN ('click', 'purchase')) AS opened
  FROM events JOIN p ON page_id = user_id GROUP BY ALL
), states AS (
  SELECT list, pattern, ts, opened, lag(opened, 1, false) OVER (PARTITION BY list, pattern ORDER BY ts) AS was FROM log
), spans AS (
  SELECT list, pattern, ts AS lo, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts) AS hi, opened FROM states WHERE opened <> was
), asked AS (
  SELECT page_id, moment, unnest(list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(string_split(path, '/'))), lambda i: host || array_to_string(string_split(path, '/')[1:i], '/') || '/'))) AS pattern
  FROM p WHERE host <> ''
), met AS (
  SELECT page_id, list, lo FROM asked JOIN spans USING (pattern) WHERE opened AND lo <= moment AND (hi IS NULL OR moment < hi)
), f AS (
  SELECT page_id, count(*) FILTER (list = 'block') AS b, count(*) FILTER (list = 'allow') AS a, min(lo) AS since FROM met GROUP BY page_id
)
SELECT page_id, url, CAST(coalesce(b, 0) AS BIGINT) AS n_block, CAST(coalesce(a, 0) AS BIGINT) AS n_allow,
       epoch_us(since) AS since_us, CASE WHEN a > 0 THEN 'allowed' WHEN b > 0 THEN 'blocked' ELSE 'open' END AS verdict
FROM p LEFT JOIN f USING (page_id)
"""

_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY t, docs),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) AS m FROM d, whole),
scored AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (rid) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _edit(state: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 's': {state}.s || {letter}}} END"


def _inserted(source: str) -> str:
    """Best string of each state after the inserts that may come next."""
    return f"""SELECT *, list_min([ui, {_edit('ai', '2', "'I'")}]) AS u1, list_min([ai, {_edit('ui', '2', "'I'")}]) AS a1 FROM
  (SELECT *, a AS ai, list_min([u, {_edit('o', '2', "'I'")}, {_edit('s', '2', "'I'")}]) AS ui FROM {source})"""


_STEP = f"""SELECT conv_id, i + 1 AS i,
  {_edit('o', '3', "'D'")} AS o,
  list_min([{_edit('s', '3', "'D'")}, CASE WHEN free AND ini = 's' THEN {_edit('o', 'extra', "'K'")} END]) AS s,
  list_min([{_edit('u1', '3', "'D'")}, {', '.join("CASE WHEN free THEN " + _edit(q, "CASE WHEN ini = 'u' THEN 0 ELSE 2 END + extra", "CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END") + " END" for q in ('o', 's', 'a1'))}]) AS u,
  list_min([{_edit('a1', '3', "'D'")}, CASE WHEN free THEN {_edit('u1', "CASE WHEN ini = 'a' THEN 0 ELSE 2 END + extra", "CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END")} END]) AS a
  FROM ({_inserted('(SELECT dp.*, f.ini, f.free, f.extra FROM dp JOIN f ON f.conv_id = dp.conv_id AND f.i = dp.i + 1)')})"""
OP13 = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), fault AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), f AS (
  SELECT *, NOT blank AND NOT again AS free, (NOT blank AND NOT again AND cut)::BIGINT AS extra FROM fault
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': ''}} AS o, NULL::STRUCT(c BIGINT, s VARCHAR) AS s, NULL::STRUCT(c BIGINT, s VARCHAR) AS u, NULL::STRUCT(c BIGINT, s VARCHAR) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL {_STEP}
), done AS (
  SELECT conv_id, list_min([o, a1]) AS best FROM ({_inserted('(SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)')})
), letters AS (
  SELECT conv_id, p, best.s[p] AS e FROM (SELECT *, unnest(range(1, length(best.s) + 1)) AS p FROM done)
), counted AS (
  SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), turns AS (
  SELECT c.conv_id, p, j, e, f.role, f.text, max((j = 1 AND e = 'K' AND f.ini = 's')::INT) OVER (PARTITION BY c.conv_id) AS led
  FROM counted c LEFT JOIN f ON f.conv_id = c.conv_id AND f.i = c.i AND c.e <> 'I' WHERE e <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t
  FROM turns GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    sum(extra)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.s AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM done LEFT JOIN counts USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": OP1,
    "op4_minhash_dedup": OP4,
    "op5_substring_dedup": OP5,
    "op7_warc": OP7,
    "op8_url_filters": OP8,
    "op9_quality_rules": OP9,
    "op11_lexical_search": OP11,
    "op13_conversation_repair": OP13,
}
# Reports on stored results of the operators, beside their own queries.
REPORTS: dict[str, str] = {"quality_ablations": ABLATIONS}
