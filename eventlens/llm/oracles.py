"""The results that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from eventlens.llm import secrets

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def substring_dedup(window: int = 20) -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
        runs AS (SELECT doc_id, s, array_to_string(w[s:s + {window - 1}], ' ') AS run FROM d, range(1, len(w) - {window - 2}) t(s)),
        later AS (SELECT doc_id, s FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
        gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range({window}) t(i)),
        placed AS (SELECT doc_id, p, w[p] AS word FROM d, range(1, len(w) + 1) t(p)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS left_over FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)"""


def jaccard_join(percent: int = 85, n: int = 4) -> str:
    text = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=text)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS shingle
              FROM d, range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {n - 2}, 2) END) t(i)),
        sizes AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 100 * overlap >= {percent} * (x.size + y.size - overlap)),
        reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
        SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""


def secret_scan(threshold: float = secrets.THRESHOLD) -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "string": secrets.STRING}
    found = " UNION ALL ".join(f"""SELECT r, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, m, gaps FROM (
        SELECT r, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS gaps FROM d) WHERE len(m) > 0"""
        for k, p in enumerate(patterns.values()))
    smooth, alphabet, any_share = secrets.SMOOTHING, secrets.ALPHABET, secrets.ANY
    share = lambda label: f"""((coalesce((SELECT n FROM counts c WHERE c.label = {label} AND c.a = p.a AND c.b = p.b), 0) + {smooth}) /
        (coalesce((SELECT sum(n) FROM counts c WHERE c.label = {label} AND c.a = p.a), 0) + {smooth} * {alphabet}))"""  # noqa: E731
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({found}),
        placed AS (SELECT r, kind, m[i] AS s, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM found),
        spans AS (SELECT *, start + length(s) AS stop, CASE WHEN kind = 0 THEN regexp_extract(s, {quoted(secrets.ASSIGN)}, 2) ELSE s END AS value FROM placed),
        base AS (SELECT * FROM spans WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= {secrets.ASSIGN_LEAST}),
        apart AS (SELECT * FROM spans x WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.start < x.stop AND x.start < b.stop)),
        samples AS (SELECT 1 AS label, value FROM base UNION ALL SELECT 0, value FROM apart WHERE regexp_matches(value, '{secrets.ORDINARY}')),
        steps AS (SELECT label, CASE WHEN i = 1 THEN '' ELSE value[i - 1] END AS a, value[i] AS b FROM samples, range(1, length(value) + 1) t(i)),
        counts AS (SELECT label, a, b, count(*) AS n FROM steps GROUP BY ALL),
        judged AS (SELECT r, start, stop, CASE WHEN i = 1 THEN '' ELSE value[i - 1] END AS a, value[i] AS b
                   FROM apart, range(1, length(value) + 1) t(i) WHERE length(value) >= {secrets.JUDGED}),
        weights AS (SELECT a, b, ln(({any_share} / {alphabet} + (1 - {any_share}) * {share(1)}) / {share(0)}) AS weight FROM (SELECT DISTINCT a, b FROM judged) p),
        likely AS (SELECT r, 3 AS kind, start, stop FROM judged JOIN weights USING (a, b)
                   WHERE (SELECT count(DISTINCT label) FROM samples) = 2 GROUP BY r, start, stop HAVING sum(weight) > {threshold}),
        marked AS (SELECT r, kind, start, stop, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop AS span
                   FROM (SELECT r, kind, start, stop FROM base UNION ALL SELECT * FROM likely)),
        listed AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                   string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM marked GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (r)"""
