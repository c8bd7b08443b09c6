"""SQL of the queries that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from .quality import LINE_LIMIT, NGRAM_LIMITS
from .secrets import EXAMPLE_OWNERS, EXAMPLE_REPOS

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def found(kind: str, rank: int, pattern: str, value: str, keep: str) -> str:
    """Matches of one kind with code point positions: running sums over the pieces between them."""
    return f"""SELECT rid, owner, repo, '{kind}' AS kind, {rank} AS rank, ahead + before AS start, ahead + before + length(m) AS stop, sha256({value}) AS hash
FROM (SELECT rid, owner, repo, m, sum(length(piece)) OVER w AS ahead, coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT rid, owner, repo, unnest(string_split_regex(t, '{pattern}')) AS piece, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(range(len(string_split_regex(t, '{pattern}')))) AS i FROM d WHERE regexp_matches(t, '{pattern}')) WINDOW w AS (PARTITION BY rid ORDER BY i))
WHERE m IS NOT NULL AND {keep}"""


SECRETS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repo FROM documents),
s AS MATERIALIZED ({found("assign", 0, ASSIGN, f"regexp_extract(m, '^{ASSIGN}$', 2)", f"length(regexp_extract(m, '^{ASSIGN}$', 2)) >= 6")}
UNION ALL {found("access", 1, "AKIA[A-Z0-9]+", "m", "length(m) >= 20")}
UNION ALL {found("hex", 2, "[0-9a-f]{24,}", "m", "true")}
UNION ALL {found("mixed", 3, "[A-Za-z0-9+/_-]{32,}", "m", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")}),
f AS (SELECT hash, count(DISTINCT owner) < {EXAMPLE_OWNERS} AND (count(DISTINCT owner) < 2 OR count(DISTINCT repo) < {EXAMPLE_REPOS}) AS live FROM s GROUP BY hash),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
  coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3 OR live), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM s JOIN f USING (hash) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, payload_bytes >= 100 AS big, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN big AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN big AND n > 1 THEN first END AS refers_to FROM r"""


def coverage(n: int) -> str:
    """Positions inside n-word windows that occur twice or more."""
    return f"""g{n} AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM (SELECT rid, i, {" || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n))} AS gram FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE gram IS NOT NULL),
c{n} AS (SELECT rid, count(*) FILTER (hit) AS words, coalesce(sum(octet_length(encode(w))) FILTER (hit), 0) AS chars FROM (SELECT words.rid, w, coalesce(max(CAST(coalesce(twice, false) AS INT)) OVER (PARTITION BY words.rid ORDER BY words.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS hit FROM words LEFT JOIN g{n} ON words.rid = g{n}.rid AND words.i = g{n}.i) GROUP BY rid)"""


SPACE = r"[^\x20\x09-\x0D]+"
QUALITY = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (SELECT rid, unnest(regexp_extract_all(t, '{SPACE}')) AS w, unnest(range(len(regexp_extract_all(t, '{SPACE}')))) AS i FROM d),
totals AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars, sum(octet_length(encode(w))) AS bytes FROM words GROUP BY rid),
lines AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d) WHERE regexp_matches(line, '{SPACE}')),
dup AS (SELECT rid, count(*) FILTER (again) AS n, coalesce(sum(octet_length(encode(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')))) FILTER (again), 0) AS chars FROM lines GROUP BY rid),
{", ".join(coverage(n) for n, _ in NGRAM_LIMITS)},
j AS (SELECT d.doc_id, coalesce(totals.n, 0) AS n_words, coalesce(totals.chars, 0) AS word_chars, coalesce(totals.bytes, 0) AS bytes, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.chars, 0) AS dup_line_chars, coalesce(c5.words, 0) AS n_repeat_words, coalesce(c5.words, 0) > 0 AS any_repeat,
  {", ".join(f"coalesce(c{n}.chars, 0) AS dup_chars_{n}" for n, _ in NGRAM_LIMITS)}
  FROM d LEFT JOIN totals USING (rid) LEFT JOIN dup USING (rid) {" ".join(f"LEFT JOIN c{n} USING (rid)" for n, _ in NGRAM_LIMITS)}),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dup_line_chars <= {LINE_LIMIT} * bytes AND {" AND ".join(f"dup_chars_{n} <= {limit} * bytes" for n, limit in NGRAM_LIMITS)} AS kept,
{", ".join(f"CAST(dup_chars_{n} AS BIGINT) AS dup_chars_{n}" for n, _ in NGRAM_LIMITS)}, CAST(dup_line_chars AS BIGINT) AS dup_line_chars FROM b"""

ORACLE_SQL = {"op1_secret_scan": SECRETS, "op9_warc": WARC, "op10_quality": QUALITY}
