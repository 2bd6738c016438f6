"""DuckDB SQL for the queries that SQL can express, each over whole tables."""

_SPACE = r"\x20\x09-\x0D"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = rf"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[{_SPACE}]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

SUBSTRING_DEDUP = rf"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words FROM documents),
    level AS (
        SELECT * FROM (
            SELECT 35 AS length, nr, pos, sha256(array_to_string(words[pos : pos + 34], ' ')) AS k
            FROM w, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS pos)
        ) QUALIFY count(*) OVER (PARTITION BY k) > 1
        UNION ALL
        SELECT * FROM (
            SELECT 2 * a.length, a.nr, a.pos, sha256(a.k || b.k) AS k
            FROM level a JOIN level b ON b.nr = a.nr AND b.pos = a.pos + a.length
        ) QUALIFY count(*) OVER (PARTITION BY k) > 1),
    gone AS (SELECT DISTINCT nr, pos + unnest(range(0, 35)) AS pos FROM level WHERE length = 35),
    t AS (SELECT nr, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
    kept AS (SELECT nr, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM t ANTI JOIN gone USING (nr, pos) GROUP BY nr),
    far AS (SELECT nr, max(length) AS longest FROM level GROUP BY nr)
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256,
           coalesce(longest, 0) AS longest
    FROM w LEFT JOIN kept USING (nr) LEFT JOIN far USING (nr)
"""

JACCARD_JOIN = rf"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all({_LOWER}, '[^{_SPACE}]+') AS words FROM documents),
    sets AS MATERIALIZED (
        SELECT nr, doc_id, CASE WHEN len(words) >= 4
            THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
        FROM w),
    g AS (SELECT nr, len(grams) AS n, unnest(grams) AS gram FROM sets),
    links AS MATERIALIZED (
        SELECT a.nr AS a, b.nr AS b FROM g a JOIN g b ON a.gram = b.gram AND a.nr <> b.nr
        GROUP BY a.nr, b.nr, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reached AS (
        SELECT nr AS a, nr AS b FROM sets
        UNION
        SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, len(s.grams) AS n_shingles, min(o.doc_id) AS component_id
    FROM sets s JOIN reached r ON r.a = s.nr JOIN sets o ON o.nr = r.b GROUP BY s.nr, s.doc_id, len(s.grams)
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(0, length({_DIGITS})),
    lambda i: CASE WHEN (1 + i % 2) * substr({_DIGITS}, length({_DIGITS}) - i::INT, 1)::INT > 9 THEN 2 * substr({_DIGITS}, length({_DIGITS}) - i::INT, 1)::INT - 9
              ELSE (1 + i % 2) * substr({_DIGITS}, length({_DIGITS}) - i::INT, 1)::INT END)) % 10 = 0"""
_CODE = "(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_MOD_97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(
    string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: {_CODE}::BIGINT)),
    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"""
#: Kind, pattern, what a match must hold, score without context, and words of context.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, r"mail|contact|write|address"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"regexp_full_match(m, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}')", 0.6, r"\bip\b|host|server|address"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", 0.8, r"card|visa|credit|pay"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", 0.6, r"phone|call|tel|mobile|fax"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD_97, 0.8, r"iban|bank|account"),
    ("short_card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 15 AND {_LUHN}", 0.3, r"card|visa|amex|credit|pay"),
    # A whole run of digits and hyphens, so that none stand beside it.
    ("national_id", r"[0-9-]+", r"regexp_full_match(m, '[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}') AND substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'", 0.3, r"\bssn\b|social|security|tax|identity"),
)


def _spans(nr: int, kind: str, pattern: str, holds: str, prior: float, context: str) -> str:
    # Positions from the lengths of the matches and of the pieces between; an underscore is no letter here.
    return rf"""
        SELECT doc, {nr} AS kind_no, '{kind}' AS kind, m, begin, begin + length(m) AS stop, {prior} AS prior,
               regexp_matches(substr(text, greatest(begin - 48, 0) + 1, least(begin, 48)) || ' ' || substr(text, begin + length(m) + 1, 24), '{context}', 'i') AS near
        FROM (
            SELECT doc, text, unnest(ms) AS m,
                   unnest(list_transform(range(1, len(ms) + 1), lambda i: (list_sum(list_transform(parts[1 : i], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0))::BIGINT)) AS begin
            FROM (SELECT doc, text, regexp_extract_all(plain, '{pattern}') AS ms, regexp_split_to_array(plain, '{pattern}') AS parts FROM d)
        ) WHERE {holds}"""


PII = rf"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text, replace(coalesce(text, ''), '_', '~') AS iban_text FROM documents),
    found AS ({" UNION ALL ".join(
        _spans(i, *kind).replace("plain", "iban_text" if kind[0] == "iban" else "text") for i, kind in enumerate(_KINDS))}),
    spans AS (
        SELECT *, least(1.0, prior + CASE WHEN near THEN 0.35 ELSE 0 END) AS score, kind || ':' || begin || ':' || stop AS span FROM found
        WHERE kind_no < 4 OR prior + CASE WHEN near THEN 0.35 ELSE 0 END >= 0.5)
    SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
           count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
           sha256(coalesce(string_agg(span, ',' ORDER BY kind_no, begin) FILTER (kind_no < 4), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY kind_no, begin), '') AS spans,
           coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY kind_no, begin), '') AS scores
    FROM d LEFT JOIN spans USING (doc) GROUP BY doc, doc_id
"""

DECONTAMINATION = rf"""
    WITH items AS (
        SELECT *, len(w) - k + 1 AS m_item FROM (SELECT *, least(5, len(w)) AS k FROM (
            SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(text), '[^{_SPACE}]+') AS w FROM benchmark) WHERE len(w) > 0)),
    item_grams AS (
        SELECT item, item_id, k, m_item, array_to_string(w[p : p + k - 1], ' ') AS gram, count(*) AS times
        FROM items, LATERAL (SELECT unnest(range(1, m_item + 1)) AS p) GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(text), '[^{_SPACE}]+') AS w FROM documents),
    doc_grams AS (
        SELECT doc, doc_id, k, p, len(w) - k + 1 AS last, array_to_string(w[p : p + k - 1], ' ') AS gram
        FROM d, (SELECT DISTINCT k FROM items), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
    hits AS MATERIALIZED (
        SELECT *, least(m_item, last) AS m FROM doc_grams JOIN item_grams USING (k, gram)
        QUALIFY count(*) OVER (PARTITION BY doc, item) >= 0.8 * m_item - 1e-9),
    starts AS (
        SELECT DISTINCT doc, item, s FROM hits, LATERAL (SELECT unnest(range(greatest(1, p - m + 1), least(p, last - m + 1) + 1)) AS s)),
    bags AS (
        SELECT doc, doc_id, item, item_id, s, k, m, m_item, least(count(*), times) AS shared FROM starts JOIN hits USING (doc, item)
        WHERE p BETWEEN s AND s + m - 1 GROUP BY doc, doc_id, item, item_id, s, k, m, m_item, gram, times),
    windows AS (
        SELECT doc, doc_id, item, item_id, s, k, m, sum(shared)::BIGINT / (m + m_item - sum(shared)::BIGINT) AS similarity
        FROM bags GROUP BY doc, doc_id, item, item_id, s, k, m, m_item)
    SELECT doc_id, item_id, s - 1 AS first_word, m + k - 1 AS n_words, similarity FROM windows WHERE similarity >= 0.8 - 1e-12
    QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY similarity DESC, s) = 1
"""

ORACLE_SQL = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op4_jaccard_join": JACCARD_JOIN,
    "op5_pii": PII,
    "op7_decontamination": DECONTAMINATION,
}
