"""SQL of the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from feedlens.llm import chat, mixing, secrets

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES["op2_mixing"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1] AS w
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS n, source, source_size, w, false AS stopped, 0.0::DOUBLE AS target FROM sources
  UNION ALL
  SELECT n + 1, source, source_size, w, stopped OR share >= 2.0 * source_size, CASE WHEN stopped OR share >= 2.0 * source_size THEN 2.0 * source_size ELSE share END
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) FILTER (stopped) OVER (), 0)) * w
               / nullif(sum(w) FILTER (NOT stopped) OVER (), 0) AS share FROM rounds) r
  WHERE n <= (SELECT count(*) FROM sources)),
targets AS (SELECT source, source_size, target FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
ranked AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         ('0x' || left(md5('{mixing.SEED}/offset|' || coalesce(d.source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY d.source ORDER BY size DESC, md5('{mixing.SEED}|' || doc_id)) AS k
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, least(floor(shift + e * k) - floor(shift + e * (k - 1)), 2)::BIGINT AS copies FROM ranked) c
"""


#: Fixed values of the query: pattern, tested group and least length of the base kinds,
#: written out so that they do not depend on the operator's own rules.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def _secret_kind(position: int, kind: str, regex: str, group: int, least: int) -> str:
    pattern = _quoted(regex)
    return f"""
SELECT rid, {position} AS ord, '{kind}' AS kind, start, start + length(whole) AS stop FROM (
  SELECT rid, found[i] AS whole, tested[i] AS tested,
         list_sum(list_transform(gaps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda s: length(s))), 0) AS start
  FROM (SELECT rid, regexp_extract_all(body, {pattern}) AS found, regexp_extract_all(body, {pattern}, {group}) AS tested,
               string_split_regex(body, {pattern}) AS gaps FROM docs), unnest(range(1, len(found) + 1)) r(i)) m
WHERE length(tested) >= {least}"""


_KINDS = (*BASE_KINDS, *((r.kind, r.pattern, r.group, r.least) for r in secrets.RULES[len(BASE_KINDS) :]))

ORACLES["op3_secrets"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(_secret_kind(i, *kind) for i, kind in enumerate(_KINDS))}),
joined AS (
  SELECT rid, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS b, count(*) FILTER (ord = 2) AS c,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)
"""

ORACLES["op5_chat"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + {len(chat.TURN + chat.TEXT + chat.END)}
           + len(regexp_extract_all(role, {_quoted(chat.CONTROL)})) + len(regexp_extract_all(text, {_quoted(chat.CONTROL)})))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op8_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
needles AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM sized, unnest(range(1, len(w) - n + 2)) r(i)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
tried AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT n FROM needles) k, unnest(range(1, len(w) - n + 2)) r(i)),
hits AS (SELECT rid, i, t.n, item_id FROM tried t JOIN needles USING (n, win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

ORACLES["op11_warc"] = f"""
WITH p AS (SELECT page_id, html, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS k,
             max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32},
         ((('0x' || substr(hex, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM d
"""
