"""DuckDB SQL for the operator queries that SQL can express over the whole tables."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from .license_templates import TEMPLATES
from .licenses import PHRASES, words_of

_REACH = (
    "e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), r(id, c) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.c), k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"
)

NEAR_DUPLICATES = (
    f"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS h FROM w), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL), "
    f"l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)), {_REACH} "
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.c, d.doc_id) AS component_id, coalesce(k.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id = d.doc_id"
)

VECTORS = (
    "WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), "
    f"l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9), {_REACH}, d AS (SELECT x, count(*) AS n FROM e GROUP BY x) "
    "SELECT m.vec_id, coalesce(d.n, 0) AS n_links, coalesce(k.c, m.vec_id) AS component_id, coalesce(k.c, m.vec_id) = m.vec_id AS kept FROM embeddings m LEFT JOIN d ON d.x = m.vec_id LEFT JOIN k ON k.id = m.vec_id"
)

WARC = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p), "
    "g AS (SELECT page_id, n, list_transform(range(0, 8), lambda i: ('0x' || h[i * 5 + 1 : i * 5 + 5])::BIGINT) AS g FROM h), "
    "b AS (SELECT page_id, n, array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS d FROM g), "
    "m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS f FROM b) "
    "SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM m"
)

CHATS = (
    "WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL), "
    "n AS (SELECT *, turn // 64 AS run, row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn, substr(sha256(role || chr(1) || text), 1, 4), role, text) - 1 AS number FROM m), "
    "q AS (SELECT *, number // 64 AS part, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body_text, replace(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), chr(10), '\\n') AS name FROM n), "
    "s AS (SELECT DISTINCT conv_id, run, part, role AS perspective FROM q WHERE role <> 'system'), "
    "v AS (SELECT conv_id, run, part, perspective, number, role, copies, CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head, body_text || '<|end|>' || chr(10) AS body FROM q JOIN s USING (conv_id, run, part)), "
    "o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, run, part ORDER BY number) AS hi FROM v) "
    "SELECT conv_id, perspective, run, CAST(part AS BIGINT) AS part, CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS n_messages, count(*) FILTER (role = perspective) AS n_trained, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars, "
    "sha256(string_agg(head || body, '' ORDER BY number)) AS rendered_sha256, coalesce(string_agg(CAST(hi - length(body) AS BIGINT) || '-' || CAST(hi AS BIGINT), ',' ORDER BY number) FILTER (role = perspective), '') AS mask "
    "FROM o GROUP BY conv_id, perspective, run, part"
)


def _pattern(template: str) -> str:
    """A template as a regular expression over words that are each followed by a blank."""
    out = " "
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<beginOptional>>":
            out += "(?:"
        elif piece == "<<endOptional>>":
            out += ")?"
        elif piece.startswith("<<var"):
            size = dict(x.split("=") for x in piece[2:-2].split(";")[1:])
            out += "(?:[^ ]+ ){%s,%s}" % (size.get("min", "0"), size["max"])
        else:
            out += "".join(w.decode() + " " for w in words_of(piece))
    return out


def _licenses() -> str:
    tests = []
    for phrase in PHRASES:
        words = phrase.split()
        tests.append("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(words)) + ")")
    places = ", ".join(f"{test} AS p{n}" for n, test in enumerate(tests))
    every = "[" + ", ".join(f"p{n}" for n in range(len(tests))) + "]"
    base = "flatten([" + ", ".join(f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, label in enumerate(PHRASES.values())) + "])"
    own = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(line, '{_pattern(text)}') THEN ['{label}'] ELSE [] END" for label, text in TEMPLATES) + "])"
    joined = "array_to_string(list_sort(list_distinct({})), ',')"
    return (
        f"WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), "
        f"l AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {places} FROM t), m AS (SELECT doc_id, len(w) AS n_words, flatten({every}) AS p, {base} AS b, {own} AS o FROM l) "
        f"SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word, {joined.format('b')} AS base_labels, {joined.format('list_concat(b, o)')} AS labels, "
        "CAST(CASE WHEN len(o) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM m"
    )


LICENSES = _licenses()
