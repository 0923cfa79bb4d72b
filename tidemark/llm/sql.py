"""DuckDB SQL of the queries that SQL can express: op3, op6, op7, op8 and op10."""

from __future__ import annotations

MARGINS = ("source", "lang", "topic")


def warc() -> str:
    """Equal payloads by value; base32 of SHA-1 in parts of 40 bits, 5 bits a digit."""
    return """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM rows
)
SELECT page_id,
  CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed"""


def urls(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(h, p, v) AS (VALUES {listed}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


def components(links: str) -> str:
    """CTEs `reach`: (node, component), the smallest node reachable over (u, v) of links."""
    return f"""
sym AS (SELECT u, v FROM {links} UNION SELECT v, u FROM {links}),
walk(node, seen) AS (SELECT DISTINCT u, u FROM sym UNION SELECT walk.node, sym.v FROM walk JOIN sym ON sym.u = walk.seen),
reach AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)"""


def vector_dedup(threshold: float = 0.98) -> str:
    """Equal vectors of a label are folded before all pairs are compared, then counted again."""
    return f"""
WITH RECURSIVE rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM rows WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
),
folded AS (SELECT label, e, min(vec_id) AS rep, count(*) AS copies FROM usable GROUP BY label, e),
pairs AS (
  SELECT a.rep AS u, b.rep AS v, a.copies AS m, b.copies AS n
  FROM folded a JOIN folded b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rep < b.rep
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}
),
around AS (SELECT rep, sum(n) AS n FROM (SELECT u AS rep, n FROM pairs UNION ALL SELECT v, m FROM pairs) GROUP BY rep),
{components("pairs")},
placed AS (
  SELECT vec_id, CAST(coalesce(around.n, 0) + copies - 1 AS BIGINT) AS n_links, coalesce(component, folded.rep) AS component_id
  FROM usable JOIN folded USING (label, e) LEFT JOIN around USING (rep) LEFT JOIN reach ON reach.node = folded.rep
),
every AS (
  SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id FROM rows LEFT JOIN placed USING (vec_id)
)
SELECT vec_id, n_links, component_id, component_id = vec_id AS kept FROM every"""


def minhash(percent: int = 85, width: int = 3) -> str:
    """All documents that share a shingle are compared; equal sets are folded first."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle}))) END AS s
  FROM words
),
folded AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
numbered AS (SELECT rep, n, hash(unnest(s)) AS h FROM folded),
common AS (
  SELECT a.rep AS u, b.rep AS v, a.n AS m, b.n AS n, count(*) AS shared
  FROM numbered a JOIN numbered b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY ALL
),
links AS (SELECT u, v FROM common WHERE 100 * shared >= {percent} * (m + n - shared)),
{components("links")}
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, rep, doc_id) AS component_id,
  coalesce(component, rep, doc_id) = doc_id AS kept
FROM sets LEFT JOIN folded ON sets.s = folded.s LEFT JOIN reach ON reach.node = folded.rep"""


def mixing(budget: float = 0.5, alphas: tuple[float, ...] = (0.5, 0.5, 1.0), rounds: int = 100) -> str:
    """Raking and calibration as recursions over the cells; each round is the three marginals in turn."""
    shares = "".join(
        f"""
share_{m} AS (
  SELECT {m}, n / sum(n) OVER () AS own, pow(n, {a}) / sum(pow(n, {a})) OVER () AS share
  FROM (SELECT {m}, sum(tokens) AS n FROM cells GROUP BY {m}) WHERE n > 0
),
fill_{m} AS (
  SELECT *, ({budget} - sum(own) OVER upto) / nullif(1 - sum(share) OVER upto, 0) AS scale_after,
    lead(own / share) OVER (ORDER BY own / share, {m}) AS next
  FROM share_{m} WINDOW upto AS (ORDER BY own / share, {m} ROWS UNBOUNDED PRECEDING)
),
scale_{m} AS (
  SELECT CASE WHEN {budget} <= min(own / share) THEN {budget} ELSE min(scale_after) FILTER (WHERE scale_after <= next) END AS s FROM fill_{m}
),
want_{m} AS (SELECT {m}, share, least(own, share * s) AS want FROM share_{m}, scale_{m}),"""
        for m, a in zip(MARGINS, alphas, strict=True)
    )
    raked = "SELECT k, source, lang, topic, tokens, total, w FROM rake WHERE k < %d" % rounds
    for m in MARGINS:
        have = f"sum(tokens * w) OVER (PARTITION BY {m})"
        raked = f"""
SELECT k, source, lang, topic, tokens, total, CASE WHEN have > 0 THEN w * coalesce(share, 0) * total / have ELSE w END AS w
FROM (SELECT *, {have} AS have FROM ({raked})) LEFT JOIN want_{m} USING ({m})"""
    drawn = "SELECT k, source, lang, topic, tokens, total, raw FROM calibrate WHERE k < %d" % rounds
    for m in MARGINS:
        drawn = f"""
SELECT k, source, lang, topic, tokens, total, raw * coalesce(
    CASE WHEN free > 0 AND 1 + (want * total - have) / free > 0 THEN 1 + (want * total - have) / free END,
    CASE WHEN have > want * total AND have > 0 THEN want * total / have END, 1.0) AS raw
FROM (SELECT *, sum(tokens * least(1.0, raw)) OVER (PARTITION BY {m}) AS have,
    sum(CASE WHEN raw < 1 THEN tokens * raw ELSE 0 END) OVER (PARTITION BY {m}) AS free FROM ({drawn})) LEFT JOIN want_{m} USING ({m})"""
    return rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(nullif(source, ''), '<none>') AS source, coalesce(nullif(lang, ''), '<none>') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'Licen') THEN 'licensed'
      WHEN regexp_matches(t, '[%$&#*!]{{2}}') THEN 'noise' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows GROUP BY ALL),{shares}
rake AS (
  SELECT 0 AS k, *, (SELECT sum(tokens) FROM cells) AS total, CAST(1 AS DOUBLE) AS w FROM cells
  UNION ALL SELECT k + 1, source, lang, topic, tokens, total, w FROM ({raked})
),
weights AS (SELECT source, lang, topic, tokens, total, w FROM rake WHERE k = {rounds}),
calibrate AS (
  SELECT 0 AS k, source, lang, topic, tokens, total, {budget} * w AS raw FROM weights
  UNION ALL SELECT k + 1, source, lang, topic, tokens, total, raw FROM ({drawn})
)
SELECT doc_id, n_tokens, source, lang, topic, round(w, 6) AS weight, round(least(1.0, raw), 6) AS probability,
  doc_id IS NOT NULL AND CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / pow(16, 13) < least(1.0, raw) AS selected
FROM rows JOIN weights USING (source, lang, topic) JOIN (SELECT source, lang, topic, raw FROM calibrate WHERE k = {rounds}) USING (source, lang, topic)"""
