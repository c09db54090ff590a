"""DuckDB SQL of the personal-data and secret queries: the same rules written as relations (matches and the text
between them give positions; windows and counts over the whole table)."""

from __future__ import annotations

from . import pii, secrets

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# the rules without the start conditions and possessive signs that only bound the cost of other engines
_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_ASSIGN = r"""["'']?\x20*[:=]\x20*["'']?"""


def _letters(words: str) -> str:
    """A rule whose ASCII letters match in either case and no other letter does ((?i) would also fold U+017F and U+212A)."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


_SHORT = f"(?:{_letters('pwd|passphrase|private_?key|credential|signature')})"
_WORD = f"(?:{_letters('password|passwd|secret|token|api_?key')})"
_SECRETS = {
    "assign": _WORD + _ASSIGN + "[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}",
    "identifier": f"(?:{_letters('user(?:_?name)?|login|account|client_?id|access_?key_?id')})" + _ASSIGN + "[A-Za-z0-9@+/_.-]{3,}",
    "key": "[A-Za-z0-9+/_-]{16,}", "key2": f"(?:{_letters('pwd|passphrase|private_?key|credential|signature')})" + _ASSIGN + "[A-Za-z0-9+/_.=-]{4,}",
    "endpoint": f"(?:{_letters('https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp')})" + r"""(?:[+:][A-Za-z]+)?://[^\s"''<>]+"""}


def _found(source: str, rules: dict[str, str], names: list[tuple[int, str]]) -> str:
    """CTEs raw and span (doc_id, no, kind, v, s, e) of the matches of each rule in ``source`` (doc_id, text)."""
    raw = " UNION ALL ".join(f"SELECT doc_id, {no} AS no, '{kind}' AS kind, string_split_regex(text, '{rule}') AS p, "
                             f"regexp_extract_all(text, '{rule}') AS m FROM {source}" for (no, kind), rule in zip(names, rules.values()))
    return f"""raw AS ({raw}),
each_ AS (SELECT doc_id, no, kind, p, m, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM raw),
span AS (SELECT doc_id, no, kind, v, s, s + length(v) AS e FROM (
  SELECT *, length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM each_))"""


def _list(columns: str, order: str, where: str = "true") -> str:
    return f"string_agg({columns}, ',' ORDER BY {order}) FILTER (WHERE {where})"


_SPAN_TEXT = "kind || ':' || s || ':' || e"
_TERM = r"[\p{L}\p{N}]+"

PII_SQL = f"""
WITH d AS (SELECT doc_id, text FROM documents),
{_found("d", _PII, list(enumerate(pii.KINDS)))},
luhn AS (SELECT doc_id, s, sum(CASE WHEN k % 2 = 0 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END) AS total FROM (
           SELECT doc_id, s, k, CAST(substr(g, CAST(length(g) - k AS BIGINT), 1) AS INTEGER) AS x FROM (
             SELECT doc_id, s, g, unnest(range(length(g))) AS k FROM (
               SELECT doc_id, s, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM span WHERE kind = 'card') WHERE length(g) BETWEEN 16 AND 19))
         GROUP BY doc_id, s),
base AS (SELECT span.doc_id, no, kind, v, span.s, e FROM span LEFT JOIN luhn ON luhn.doc_id = span.doc_id AND luhn.s = span.s AND kind = 'card'
         WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN regexp_full_match(v, '{_OCTET}(\\.{_OCTET}){{3}}')
               WHEN 'card' THEN coalesce(total % 10 = 0, false)
               ELSE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 END),
cutw AS (SELECT doc_id, string_split_regex(text, '{_TERM}') AS p, regexp_extract_all(text, '{_TERM}') AS m FROM d
         WHERE doc_id IN (SELECT doc_id FROM base)),
word AS (SELECT doc_id, lower(v) AS term, e - length(v) AS s, e FROM (
           SELECT doc_id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
             SELECT doc_id, unnest(m) AS v, unnest(p[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM cutw))),
free AS (SELECT * FROM word WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = word.doc_id AND word.s < b.e AND b.s < word.e)),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, coalesce(text, '') FROM d)),
ent AS (SELECT DISTINCT doc_id, kind, lower(v) AS entity FROM base),
ne AS (SELECT kind, entity, count(*) AS n_e FROM ent GROUP BY 1, 2),
dt AS (SELECT DISTINCT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS w FROM d)),
nt AS (SELECT term, count(*) AS n_t FROM dt GROUP BY term),
net AS (SELECT kind, entity, term, count(*) AS n_et FROM ent JOIN dt USING (doc_id) GROUP BY 1, 2, 3),
flag AS (SELECT kind, entity, term FROM net JOIN ne USING (kind, entity) JOIN nt USING (term), total
         WHERE n_e < n AND log2((n_et + {pii.PRIOR} * n_t / n) / (n_e + {pii.PRIOR}) * n / n_t) / log2(CAST(n AS DOUBLE) / n_e) >= {pii.GENERALISE_AT} - 1e-9),
term AS (SELECT DISTINCT free.doc_id, s, e FROM free JOIN ent USING (doc_id) JOIN flag USING (kind, entity, term)),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.KINDS)},
             {_list(_SPAN_TEXT, "no, s")} AS spans FROM base GROUP BY doc_id),
t AS (SELECT doc_id, {_list("'term:' || s || ':' || e", "s")} AS spans FROM term GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(b.spans, '')) AS base_sha256,
       concat_ws(',', b.spans, t.spans) AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)"""

_NAMES = [*enumerate(secrets.KINDS), (3, "identifier"), (4, "key"), (4, "key"), (5, "endpoint")]

SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, text FROM documents),
{_found("d", _SECRETS, _NAMES)},
valid AS (SELECT * FROM span WHERE CASE no
            WHEN 0 THEN length(regexp_extract(v, '{_WORD}{_ASSIGN}(.*)$', 1)) >= 6
            WHEN 4 THEN regexp_matches(v, '^{_SHORT}{_ASSIGN}') AND regexp_matches(v, '[:=]')
                        OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
            ELSE true END),
base AS (SELECT * FROM valid WHERE no < 3),
part AS (SELECT * FROM base UNION ALL
         SELECT * FROM valid w WHERE no >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND w.s < b.e AND b.s < w.e)),
seen AS (SELECT *, bool_or(kind IN ('assign', 'hex', 'key')) OVER near_ AS with_secret,
                bool_or(kind IN ('access', 'identifier', 'endpoint')) OVER near_ AS with_other FROM part
         WINDOW near_ AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {secrets.SCOPE} PRECEDING AND {secrets.SCOPE} FOLLOWING)),
every AS (SELECT DISTINCT doc_id, no, kind, s, e FROM seen WHERE no < 3 OR kind = 'key' AND with_other OR no IN (3, 5) AND with_secret),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.KINDS)},
             {_list(_SPAN_TEXT, "s, no, e", "no < 3")} AS base, {_list(_SPAN_TEXT, "s, no, e")} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
