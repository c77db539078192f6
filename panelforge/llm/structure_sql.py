"""SQL of the queries on conversation prefixes, personal data and conversation repair."""

from __future__ import annotations

from panelforge.llm import personal_data as pd

__all__ = ["PERSONAL_DATA", "PREFIX_TRIE", "TURN_REPAIR"]


def crc32(text: str) -> str:
    """CRC-32 of a text without other characters than ASCII, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda k: CAST((ascii(({text})[k // 8 + 1]) >> (k % 8)) & 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"


PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, octet_length(encode(coalesce(text, ''))) AS size,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said
  FROM conversations
), convs AS (SELECT c, {crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations)),
turns AS (
  SELECT c, 0 AS part, p, size, said FROM convs JOIN own ON own.conv_id = c - c % 5 AND p <= h
  UNION ALL SELECT c, 1, p, size, said FROM convs JOIN own ON own.conv_id = c AND p > h
), placed AS (SELECT c, size, md5(said) AS said, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM turns),
members AS (
  SELECT c, 0 AS d, 0 AS size, 'root' AS node, NULL AS parent FROM convs
  UNION ALL SELECT c, d, size, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), 'root')
  FROM (SELECT c, d, size, md5(string_agg(said, ',') OVER (PARTITION BY c ORDER BY d)) AS node FROM placed)
), nodes AS (SELECT node, any_value(parent) AS parent, min(c) AS conv_id, min(d) AS depth, count(*) AS n, min(size) AS size FROM members GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
tree AS (SELECT DISTINCT a.node AS top, b.node FROM members a JOIN members b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT top AS node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n - 1) * size) AS saved FROM tree JOIN nodes USING (node) LEFT JOIN kids k USING (node) GROUP BY top
), ends AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, node FROM members QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY node
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids k ON k.node = x.node JOIN sums s ON s.node = x.node LEFT JOIN ends e ON e.node = x.node
"""

_EDIT = "lpad(CAST(CAST(substr({0}, 1, 10) AS BIGINT) + {1} AS VARCHAR), 10, '0') || '{2}' || substr({0}, 11)".format

#: A way's rank is its cost in ten digits, then its audit, so that text order is the order of repairs.
TURN_REPAIR = rf"""
WITH RECURSIVE faulty AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM faulty, (VALUES (0), (1)) AS v(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), bodies AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), flags AS (
  SELECT *, last_char = '' AS blank, last_char <> '' AND nth > 1 AS duplicate, last_char <> '' AND nth = 1 AND last_char NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS ini FROM bodies
), steps AS (
  SELECT conv_id, i, role, text, ini, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS pen FROM flags
), dp AS (
  SELECT conv_id, max(i) AS i, '0000000000' AS w0, '0000000006II' AS w1, '0000000003I' AS w2, '0000000000' AS w3 FROM flags GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(b0, {_EDIT("x2", 3, "I")}), least(b1, {_EDIT("x2", 3, "I")}), x2, x3
  FROM (
    SELECT *, least(b2, {_EDIT("b3", 3, "I")}) AS x2, least(b3, {_EDIT("b2", 3, "I")}) AS x3
    FROM (
      SELECT dp.conv_id, dp.i - 1 AS i,
             least({_EDIT("w0", 4, "D")}, CASE WHEN NOT gone THEN {_EDIT("w2", "3 + pen", "R")} ELSE 'z' END, CASE WHEN NOT gone AND ini = 's' THEN {_EDIT("w1", "pen", "K")} WHEN NOT gone AND ini = 'u' THEN {_EDIT("w2", "pen", "K")} ELSE 'z' END) AS b0,
             least({_EDIT("w1", 4, "D")}, CASE WHEN NOT gone THEN {_EDIT("w2", "3 + pen", "R")} ELSE 'z' END, CASE WHEN NOT gone AND ini = 'u' THEN {_EDIT("w2", "pen", "K")} ELSE 'z' END) AS b1,
             least({_EDIT("w2", 4, "D")}, CASE WHEN NOT gone THEN {_EDIT("w3", "3 + pen", "R")} ELSE 'z' END, CASE WHEN NOT gone AND ini = 'a' THEN {_EDIT("w3", "pen", "K")} ELSE 'z' END) AS b2,
             least({_EDIT("w3", 4, "D")}, CASE WHEN NOT gone THEN {_EDIT("w2", "3 + pen", "R")} ELSE 'z' END, CASE WHEN NOT gone AND ini = 'u' THEN {_EDIT("w2", "pen", "K")} ELSE 'z' END) AS b3
      FROM dp JOIN steps s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i
    )
  )
), plans AS (SELECT conv_id, CAST(substr(w0, 1, 10) AS BIGINT) AS cost, substr(w0, 11) AS audit FROM dp WHERE i = 0),
letters AS (
  SELECT conv_id, p, audit[p] AS e, length(regexp_replace(audit[1:p], 'I', '', 'g')) AS i, length(regexp_replace(audit[1:p], 'D', '', 'g')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM plans)
), put AS (
  SELECT l.conv_id, l.e, place, CASE WHEN e <> 'I' THEN s.role END AS role, CASE WHEN e = 'I' THEN '' ELSE s.text END AS text,
         first_value(CASE WHEN e = 'K' AND s.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY place) AS lead_in
  FROM letters l LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.i WHERE e <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - 1 - lead_in) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS sha FROM put GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM flags) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_BASE = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
    "card": "[0-9]([\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "head": "[A-Z]{2}[0-9]{2}",
}


def _matches(table: str, columns: str, text: str, pattern: str) -> str:
    """Rows of table with each match m of the pattern and its start, from the lengths of what stands between matches."""
    return f"""(SELECT {columns}, m[i] AS m, CAST(list_sum(list_transform(list_slice(s, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS s FROM {table}) WHERE len(m) > 0))"""


def _luhn(digits: str) -> str:
    doubled = f"list_transform(range(1, length({digits}) + 1), lambda k: CAST(reverse({digits})[k] AS BIGINT) * (2 - k % 2) - CASE WHEN k % 2 = 0 AND CAST(reverse({digits})[k] AS BIGINT) > 4 THEN 9 ELSE 0 END)"
    return f"(length({digits}) BETWEEN 14 AND 19 AND list_sum({doubled}) % 10 = 0)"


def _near(kind: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower(substr(t, greatest(start - {pd.NEARBY}, 0) + 1, least(start, {pd.NEARBY}))), '(^|[^a-z])({'|'.join(words)})([^a-z]|$)')"


_LENGTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pd.IBAN_LENGTHS.items()) + "}"

PERSONAL_DATA = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(f"{k}s AS {_matches('texts', 'r, t', 't', v)}" for k, v in _BASE.items())},
judged_cards AS (SELECT r, t, m, pos, regexp_replace(m, '[ -]', '', 'g') AS d FROM cards),
good_cards AS (SELECT *, {_luhn("d")} AS good FROM judged_cards),
good_phones AS (SELECT *, length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AS good, regexp_extract(m, '^(\+[0-9]{{1,3}} ?\([0-9]{{2,4}}\) ?[0-9]{{3}}-[0-9]{{4}})([^0-9]|$)', 1) AS tel FROM phones),
pans AS (SELECT r, t, m, whole + pos AS start FROM {_matches("(SELECT r, t, m AS run, pos AS whole FROM good_cards WHERE NOT good)", "r, t, whole", "run", "[0-9]+")}),
ibans AS (SELECT r, t, pos, regexp_extract(substr(t, pos + 1, 64), '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]){{11,30}}') AS m FROM heads),
accounts AS (SELECT *, replace(m, ' ', '')[1:n] AS a FROM (SELECT *, {_LENGTHS}[m[1:2]] AS n FROM ibans) WHERE m <> '' AND n <= length(replace(m, ' ', ''))),
found AS (
  SELECT r, t, 'email' AS kind, 0 AS rank, pos AS start, pos + length(m) AS stop FROM emails
  UNION ALL SELECT r, t, 'ip', 1, pos, pos + length(m) FROM ips WHERE list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS BIGINT), 0) <= 255))
  UNION ALL SELECT r, t, 'card', 2, pos, pos + length(m) FROM good_cards WHERE good
  UNION ALL SELECT r, t, 'phone', 3, pos, pos + length(m) FROM good_phones WHERE good
  UNION ALL SELECT r, t, 'pan', 4, start, start + length(m) FROM pans WHERE {_luhn("m")} AND (NOT {_near("pan", pd.CONTEXTS["pan"].less)} OR {_near("pan", pd.CONTEXTS["pan"].more)})
  UNION ALL SELECT r, t, 'tel', 5, pos, pos + length(tel) FROM good_phones WHERE NOT good AND tel <> ''
  UNION ALL SELECT r, t, 'ssn', 6, start, start + length(m) FROM (SELECT r, t, m, pos AS start FROM good_cards WHERE NOT good)
    WHERE regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000' AND {_near("ssn", pd.CONTEXTS["ssn"].more)}
  UNION ALL SELECT r, t, 'iban', 7, pos, pos + list_filter(range(1, length(m) + 1), lambda k: length(replace(m[1:k], ' ', '')) = n)[1] FROM accounts
    WHERE list_reduce(list_prepend(0::BIGINT, list_transform(string_split(a[5:] || a[1:4], ''), lambda c: CAST(CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda x, d: (x * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1
), spans AS (SELECT r, kind, rank, start, kind || ':' || start || ':' || stop AS span FROM found)
SELECT any_value(x.doc_id) AS doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (span IS NOT NULL), '') AS spans
FROM texts x LEFT JOIN spans s ON s.r = x.r GROUP BY x.r
"""
