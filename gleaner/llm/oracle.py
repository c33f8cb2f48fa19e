"""SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = (
    f"regexp_extract_all(translate(coalesce({{0}}, ''), '{UPPER}', '{LOWER}'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format("text")} AS words FROM benchmark),
w AS (SELECT *, least(10, len(words)) AS n FROM i WHERE len(words) > 0),
iw AS (
  SELECT DISTINCT item, n, array_to_string(words[j + 1 : j + n], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(words) - n + 1)) AS j FROM w)
),
dw AS (
  SELECT doc_id, n, j, array_to_string(words[j + 1 : j + n], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS j
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)
),
m AS (SELECT doc_id, j, n, item FROM dw JOIN iw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM m) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""

DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
LUHN = """list_sum(list_transform(range(1, len({0}) + 1), lambda k:
    CASE WHEN (len({0}) - k) % 2 = 0 THEN CAST({0}[k] AS INT)
         WHEN CAST({0}[k] AS INT) > 4 THEN 2 * CAST({0}[k] AS INT) - 9 ELSE 2 * CAST({0}[k] AS INT) END)) % 10 = 0"""
TURNED = "substr(replace({0}, ' ', ''), 5) || substr(replace({0}, ' ', ''), 1, 4)"
MOD97 = f"""list_reduce(list_transform(string_split({TURNED}, ''), lambda c: strpos('0123456789{UPPER}', c) - 1),
    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, CAST(0 AS BIGINT)) = 1"""

# kind, pattern, condition over m (the match) and near (the text around it)
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
     "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR "
     "coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0"),
    ("card", "[0-9](?:[ -]?[0-9])+",
     f"len({DIGITS.format('m')}) BETWEEN 13 AND 19 AND {LUHN.format(DIGITS.format('m'))}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"len({DIGITS.format('m')}) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
     f"len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {MOD97.format('m')}"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
     "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, '\\bssn\\b|social|security')"),
)


def _kind(name: str, pattern: str, condition: str) -> str:
    return f"""
{name}_parts AS (
  SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS found
  FROM d WHERE len(regexp_extract_all(text, '{pattern}')) > 0
),
{name}_at AS (
  SELECT doc_id, found[k] AS m,
         CAST(coalesce(list_sum(list_transform(pieces[1:k], lambda x: len(x))), 0)
              + coalesce(list_sum(list_transform(found[1 : k - 1], lambda x: len(x))), 0) AS BIGINT) AS s,
         lower(right(pieces[k], 48) || ' ' || left(pieces[k + 1], 24)) AS near
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM {name}_parts)
),
{name}_spans AS (
  SELECT doc_id, count(*) AS n, string_agg('{name}:' || s || ':' || (s + len(m)), ',' ORDER BY s) AS spans
  FROM {name}_at WHERE {condition} GROUP BY doc_id
)"""


def personal_data() -> str:
    names = [k[0] for k in KINDS]
    joins = " ".join(f"LEFT JOIN {n}_spans USING (doc_id)" for n in names)
    counts = ", ".join(f"CAST(coalesce({n}_spans.n, 0) AS BIGINT) AS n_{n}" for n in names[:4])
    base = ", ".join(f"{n}_spans.spans" for n in names[:4])
    every = ", ".join(f"{n}_spans.spans" for n in names)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
        + ",".join(_kind(*k) for k in KINDS)
        + f" SELECT doc_id, {counts}, sha256(concat_ws(',', {base})) AS base_sha256, concat_ws(',', {every}) AS spans FROM d {joins}"
    )


# Prefixes are lists of turns; a node is the set of conversations with equal prefixes.
PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list(turn ORDER BY n) AS turns FROM t GROUP BY 1),
crc AS (
  SELECT conv_id, turns, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)) AS c
  FROM own
),
heads AS (SELECT conv_id, turns, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1 :]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
),
p AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS pre FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends,
         CASE WHEN d > 0 THEN strlen(any_value(pre[d].t)) ELSE 0 END AS bytes
  FROM p GROUP BY d, pre
),
kids AS (SELECT d - 1 AS d, pre[1 : d - 1] AS pre, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
named AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, pre)),
below AS (
  SELECT a AS d, pre[1:a] AS pre, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM named) GROUP BY ALL
)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM named m JOIN below b ON b.d = m.d AND b.pre = m.pre LEFT JOIN nodes u ON u.d = m.d - 1 AND u.pre = m.pre[1 : m.d - 1]
"""

ORACLE = {"op3_pii": personal_data(), "op7_decontamination": DECONTAMINATION, "op9_warc": WARC, "op13_prefix_trie": PREFIX_TRIE}
