"""SQL of the registered queries, for those that it can express.

op1, op4, op9 and op10 rest on models, signatures and a tokenizer, op5 on the places
of matches and op8 on hashes that SQL lacks; tests compare these with brute force.
"""

from __future__ import annotations

from slotlake.llm.licenses import LINES, PARAGRAPHS, RULES, SENTENCES, covered_by, pattern

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

# The mix takes the first words of each source's shuffled stream, read up to twice.
MIX = r"""
WITH s AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS key
  FROM documents
), by_source AS (
  SELECT source, sum(size) AS source_size FROM s GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM by_source
), capped AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST(idx % 3 AS INTEGER) + 1] AS weight,
         2.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total
  FROM numbered
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), level AS (
  SELECT max(level) AS level FROM levels WHERE cap > level * weight
), targets AS (
  SELECT source, source_size, least(cap, (SELECT level FROM level) * weight) AS target
  FROM capped
), placed AS (
  SELECT s.*, t.source_size, t.target, least(floor(t.target + 0.5), 2 * t.source_size) AS quota,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(pos + size, quota) - pos)
         + greatest(0, least(source_size + pos + size, quota) - source_size - pos) AS BIGINT) AS taken, source
FROM placed"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, url, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), named AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
      (CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '')
      AS payload_digest,
    split_part(url, '://', 2) AS tail
  FROM d
), keyed AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
    array_to_string(list_reverse(string_split(lower(regexp_extract(tail, '^[^/?#]*')), '.')), ',')
      || ')' || substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1) AS urlkey,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS date
  FROM named
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       TRUE AS intact, urlkey, date,
       row_number() OVER (ORDER BY urlkey, date, page_id) - 1 AS position
FROM keyed"""


def _licenses() -> str:
    known = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    match = [f"regexp_matches(line, '{pattern(r)}')" for r in RULES]
    hits = [
        f"CASE WHEN {' AND NOT '.join([match[k], *[match[j] for j in covered_by(RULES, k)]])} THEN {k} END"
        for k in range(len(RULES))
    ]
    names = ", ".join(f"'{r.license}'" for r in RULES)
    permissive = ", ".join(str(r.permissive) for r in RULES)
    ids = rf"""list_filter(list_transform(%s, lambda s:
    MAP {{{known}}}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' ')]), lambda x: x IS NOT NULL)"""
    return rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{LINES}'), lambda s: trim(s, ' ') <> '') AS lines,
    regexp_split_to_array(coalesce(text, ''), '{PARAGRAPHS}') AS parts FROM documents
), i AS (
  SELECT doc_id, len(lines) AS n, {ids % 'lines'} AS a, {ids % 'parts'} AS b FROM t
), l AS (
  SELECT *, CASE WHEN len(a) > len(b) THEN a ELSE b END AS ids,
    ';' || array_to_string(a, ';') || ';|;' || array_to_string(b, ';') || ';' AS line FROM i
), h AS (
  SELECT *, list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL) AS hits FROM l
)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known,
       array_to_string(ids, ',') AS sequence,
       array_to_string(list_transform(hits, lambda k: [{names}][k + 1]), ',') AS licenses,
       CAST(len(hits) AS BIGINT) AS n_licenses,
       CASE WHEN len(hits) > 0 THEN len(list_filter(hits, lambda k: NOT [{permissive}][k + 1])) = 0 END AS permissive
FROM h"""


# crc32 is folded over a word's bytes by a table that SQL makes itself.
SPELLING = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY doc_id, run
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END)) AS b
  FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest
  FROM words, unnest(range(0, length(word))) AS u(k)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place,
         count(*) OVER (PARTITION BY word) AS n_near FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.onward IS NULL"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) END AS shingles
  FROM w
), by_set AS (
  SELECT list_sort(shingles) AS shingles, min(doc_id) AS node FROM s WHERE len(shingles) > 0 GROUP BY 1
), x AS (
  SELECT node, len(shingles) AS size, unnest(shingles) AS shingle FROM by_set
), links AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.node <> b.node
    AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), reach AS (
  SELECT node, node AS goal FROM by_set UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.goal
), named AS (
  SELECT b.shingles, min(r.goal) AS component_id FROM by_set b JOIN reach r ON r.node = b.node GROUP BY b.shingles
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(n.component_id, s.doc_id) AS kept
FROM s LEFT JOIN named n ON n.shingles = list_sort(s.shingles)"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Nearest entries by looking at all of them, round after round."""
    assign = """
a{r} AS (
  SELECT id, part, label, v, min_by(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (
    SELECT p.id, p.part, p.label, p.v, b.entry,
      CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{r} b ON p.part = b.part) GROUP BY id, part, label, v)"""
    refine = """
m{r} AS (
  SELECT part, entry, list(m ORDER BY k) AS v FROM (
    SELECT part, entry, k, (sum(v[k]) - ((sum(v[k]) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM a{q}, unnest(range(1, len(v) + 1)) AS u(k) GROUP BY part, entry, k) GROUP BY part, entry
), b{r} AS (
  SELECT b.part, b.entry, list_transform(coalesce(m.v, b.v), lambda x: CAST(x AS BIGINT)) AS v
  FROM b{q} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
    steps = []
    for r in range(rounds + 1):
        if r:
            steps.append(refine.format(r=r, q=r - 1))
        steps.append(assign.format(r=r))
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT id, vec_id, label, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS v
  FROM v, unnest(range(0, {parts})) AS u(part)
), b0 AS (
  SELECT part, id - 1 AS entry, v FROM p WHERE id <= {entries}
), {",".join(steps)},
found AS (
  SELECT id, label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY id, label
)
SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY f.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256, f.label
FROM found f JOIN v ON v.id = f.id"""


ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": TOP_K,
    "op3_mix_sources": MIX,
    "op6_warc_round_trip": WARC,
    "op7_license_scan": _licenses(),
    "op11_spelling_variants": SPELLING,
    "op12_hamming_near_dup": NEAR_DUPLICATES,
    "op13_vector_codes": _codes(),
}
