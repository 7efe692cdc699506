"""SQL counterparts of the queries that SQL can express, for DuckDB on the same tables."""

WORD = r"[^\x20\x09-\x0D]+"

_CANONICAL = r"""
    regexp_replace(regexp_replace(lower(
        regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)', 1)), '^www\d*\.', ''), ':(80|443)?$', '')
    || regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN regexp_extract(u, '\?(.*)$', 1) = '' THEN ''
            ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')), '&') END
"""

ORACLES = {
    "op2_revisits": rf"""
WITH page AS (
    SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, coalesce(html, '') AS body, html,
           1700000000 + page_id * 60 AS ts, page_id % 7 AS kind, (page_id * 7919) % 604800 + 30 AS delay
    FROM pages
), named AS (SELECT *, {_CANONICAL} AS url, md5(body) AS tag FROM page),
stored AS (SELECT page_id * 2 AS source_id, url, ts, tag, html, length(body) AS n FROM named),
asked AS (SELECT *, ts + delay AS asked_ts FROM named),
met AS (
    SELECT a.page_id * 2 + 1 AS record_id, a.url, s.source_id, s.tag AS old_tag, s.ts AS old_ts, s.html AS old_html, s.n,
           a.kind, a.asked_ts, a.ts, a.tag || CASE WHEN a.kind < 2 THEN '0' ELSE '' END AS new_tag
    FROM asked a ASOF LEFT JOIN stored s ON a.url = s.url AND a.asked_ts > s.ts
), judged AS (
    SELECT *, CASE WHEN source_id IS NULL THEN 'no_response'
                   WHEN kind < 5 THEN CASE WHEN new_tag = old_tag THEN 'etag' ELSE 'mismatch' END
                   WHEN kind = 5 THEN CASE WHEN ts = old_ts THEN 'last_modified' ELSE 'mismatch' END
                   ELSE 'unchecked' END AS verdict
    FROM met
)
SELECT record_id, url, source_id, verdict,
       CASE WHEN verdict IN ('etag', 'last_modified', 'unchecked') THEN
           concat_ws(chr(10), 'cache-control: max-age=120', 'content-length: ' || n, 'content-type: text/html',
               'date: t' || asked_ts, 'etag: ' || CASE WHEN kind < 5 THEN 'W/"' || new_tag || '"' ELSE '"' || old_tag || '"' END,
               'last-modified: t' || CASE WHEN kind = 5 THEN ts ELSE old_ts END)
       ELSE concat_ws(chr(10), 'cache-control: max-age=120', 'content-length: 0', 'date: t' || asked_ts,
               CASE WHEN kind < 5 THEN 'etag: W/"' || new_tag || '"' END, CASE WHEN kind = 5 THEN 'last-modified: t' || ts END)
       END AS headers,
       CASE WHEN verdict IN ('etag', 'last_modified', 'unchecked') THEN md5(old_html) END AS payload_md5,
       CASE WHEN verdict IN ('etag', 'last_modified', 'unchecked') THEN length(old_html) END AS payload_chars
FROM judged
""",
    "op4_mix": rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3, 1, 2][(place - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
           sum(source_size) OVER () * 1.5::DOUBLE AS budget
    FROM sources
), rounds AS (  -- each round stops the sources that the level of the rest overfills
    SELECT place, w, cap, budget, false AS full_, 0 AS round FROM weighed
    UNION ALL
    SELECT place, w, cap, budget, full_ OR cap <= level * w, round + 1 FROM (
        SELECT *, (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / (sum(w) FILTER (NOT full_) OVER ()) AS level,
               round < (SELECT count(*) FROM weighed) AS more
        FROM rounds
    ) WHERE more
), last AS (SELECT * FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
levels AS (
    SELECT place, CASE WHEN full_ THEN cap
        ELSE (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / (sum(w) FILTER (NOT full_) OVER ()) * w END AS target
    FROM last
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
    FROM sized JOIN weighed ON sized.source IS NOT DISTINCT FROM weighed.source JOIN levels USING (place)
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""",
    "op6_line_runs": r"""
WITH split_ AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o
    FROM documents
), full_ AS (
    SELECT doc_id, line, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i
    FROM split_ WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs AS (
    SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line FROM full_
), firsts AS (
    SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) AS copy FROM pairs WHERE next_line IS NOT NULL
), gone AS (
    SELECT doc_id, i FROM firsts WHERE copy > 1 UNION SELECT doc_id, i + 1 FROM firsts WHERE copy > 1
    UNION SELECT doc_id, i FROM (  -- a line of more than fifty words is a passage by itself
        SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS copy FROM full_
        WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50
    ) WHERE copy > 1
), marked AS (
    SELECT f.doc_id, f.o, f.i, g.i IS NOT NULL AS cut FROM full_ f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.i = g.i
), every_ AS (  -- a blank line goes if the non-blank lines on both sides go as one run
    SELECT s.doc_id, s.line, s.o, m.cut,
           last_value(m.cut IGNORE NULLS) OVER (PARTITION BY s.doc_id ORDER BY s.o) AS before_,
           first_value(m.cut IGNORE NULLS) OVER (PARTITION BY s.doc_id ORDER BY s.o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_
    FROM split_ s LEFT JOIN marked m ON s.doc_id = m.doc_id AND s.o = m.o
)
SELECT d.doc_id,
       CASE WHEN e.n_removed > 0 THEN coalesce(e.left_, '') ELSE d.text END AS text,
       coalesce(e.n_lines, 0) AS n_lines, coalesce(e.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN (
    SELECT doc_id, count(cut) AS n_lines, count(*) FILTER (cut) AS n_removed,
           string_agg(line, chr(10) ORDER BY o) FILTER (NOT coalesce(cut, coalesce(before_, false) AND coalesce(after_, false))) AS left_
    FROM every_ GROUP BY doc_id
) e ON d.doc_id = e.doc_id
""",
    "op10_quality": rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), grams AS (
    SELECT r, p, unnest_.w3, count(*) OVER (PARTITION BY r, unnest_.w3) AS n
    FROM (SELECT r, unnest(range(1, greatest(len(words) - 1, 1))) AS p, words FROM docs WHERE len(words) > 2) x,
         LATERAL (SELECT list_slice(x.words, x.p, x.p + 2) AS w3) unnest_
), repeats AS (
    SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM grams WHERE n > 1) GROUP BY r
), lines AS (
    SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM docs
), full_ AS (
    SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n,
           row_number() OVER (PARTITION BY r, line ORDER BY o) AS copy,
           regexp_replace(lower(array_to_string(regexp_extract_all(line, '{WORD}'), ' ')), '[0-9]+', '0', 'g') AS plain
    FROM lines WHERE regexp_matches(line, '{WORD}')
), dups AS (SELECT r, count(*) FILTER (copy > 1) AS n_dup_lines FROM full_ GROUP BY r),
hosts AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY source),
common AS (
    SELECT f.source, plain FROM full_ f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
    GROUP BY f.source, plain, n_docs HAVING count(DISTINCT r) > greatest(20, 0.01 * n_docs)
), removed AS (
    SELECT r, sum(n)::BIGINT AS n_removed FROM full_ f JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.plain = c.plain GROUP BY r
), told AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
           coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
    FROM docs d LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= 0.7 * n_words AS kept
FROM told
""",
}


def _codebooks_sql(rounds: int = 4, entries: int = 256) -> str:
    """Assignment and floored means, written out for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT r, p, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d FROM (
        SELECT r, part.p, e, list_sum(list_transform(list_zip(x, c), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)) AS d
        FROM part JOIN book{k} USING (p)
    ) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""moved{k} AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
        SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM near{k} JOIN part USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM part) + 1)) AS i)
        GROUP BY p, e, i
    ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(m.c, b.c)::BIGINT[] AS c FROM book{k} b LEFT JOIN moved{k} m USING (p, e)
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
           list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
    SELECT r, vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {entries}),
{", ".join(steps)},
said AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM near{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, said
"""


ORACLES["op11_codebooks"] = _codebooks_sql()
