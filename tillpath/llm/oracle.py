"""SQL for the text operators' queries that SQL can express."""

from __future__ import annotations

MIXING = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
ranked AS (
  SELECT source, sqrt(n) AS w,
         row_number() OVER (ORDER BY n DESC, source ASC NULLS FIRST) - 1 AS lane
  FROM sizes),
shares AS (
  SELECT source, lane, w / (SELECT sum(w) FROM ranked) * (1000 - (SELECT count(*) FROM ranked)) AS exact
  FROM ranked),
placed AS (
  SELECT source, lane, floor(exact) AS whole,
         row_number() OVER (ORDER BY floor(exact) - exact, lane) AS place FROM shares),
lanes AS (
  SELECT source, lane,
         CAST(whole + 1 + CASE WHEN place <= (1000 - (SELECT count(*) FROM placed)
           - (SELECT sum(whole) FROM placed)) THEN 1 ELSE 0 END AS BIGINT) AS units
  FROM placed),
given AS (SELECT list(units ORDER BY lane) AS us FROM lanes),
edf AS (
  SELECT -1 AS t, -1 AS lane, list_transform(us, lambda u: 0) AS used FROM given
  UNION ALL
  SELECT t + 1, pick, list_transform(used, lambda x, i: CASE WHEN i - 1 = pick THEN x + 1 ELSE x END)
  FROM (
    SELECT t, used, (list_min(list_filter(list_transform(us, lambda u, i:
      CASE WHEN used[i] * 1000 // u <= t + 1
           THEN (((used[i] + 1) * 1000 + u - 1) // u) * 1000 + i - 1 END),
      lambda x: x IS NOT NULL)) % 1000)::INT AS pick
    FROM edf, given WHERE t < 999)),
phases AS (
  SELECT lane, t AS phase, row_number() OVER (PARTITION BY lane ORDER BY t) - 1 AS k
  FROM edf WHERE t >= 0),
docs AS (
  SELECT d.doc_id, d.source, l.lane, l.units,
         row_number() OVER (PARTITION BY l.lane ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1
           AS rank
  FROM documents d JOIN lanes l ON d.source IS NOT DISTINCT FROM l.source),
blocks AS (SELECT *, rank // 16 AS block FROM docs),
slotted AS (
  SELECT b.*, b.block // b.units * 1000 + p.phase AS slot
  FROM blocks b JOIN phases p ON p.lane = b.lane AND p.k = b.block % b.units)
SELECT doc_id, source, CAST(lane AS INT) AS lane, block, slot,
       block * 1000 // units AS release,
       ((block + 1) * 1000 + units - 1) // units AS deadline,
       row_number() OVER (ORDER BY slot, rank % 16) - 1 AS position
FROM slotted
"""

URL_RULES = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0
         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hosts AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM split),
rules(host, path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT h.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM hosts h JOIN rules r
    ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN fits f ON h.page_id = f.page_id
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SPELLING = f"""
WITH RECURSIVE steps AS (
  SELECT b AS byte, b AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}), '[a-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times FROM found GROUP BY doc_id, run),
keyed AS (
  SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS octets FROM runs),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(octets) // 2),
      lambda i: CAST('0x' || substr(octets, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM keyed, crc),
slipped AS (
  SELECT times, CASE WHEN h % 97 = 0
    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5
  GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, i, left(word, i - 1) AS before, substr(word, i + 1) AS after FROM places),
shorter AS (SELECT DISTINCT word, before || after AS less FROM cut),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b
    ON a.i = b.i AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.less
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.less),
ranked AS (
  SELECT near.word, near.other, words.n,
         row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, near.other) AS place,
         count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN words ON words.word = near.other),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.n >= 2 * w.n THEN r.other END AS form,
         CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS last, 0 AS k FROM forms
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""

MINHASH = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, {LOWER}), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    END)) AS held
  FROM texts),
different AS (SELECT held, min(r) AS r, len(held) AS n FROM sets WHERE len(held) > 0 GROUP BY held),
shingles AS (SELECT r, n, unnest(held) AS shingle FROM different),
pairs AS (
  SELECT a.r AS u, b.r AS v, a.n + b.n - count(*) AS all_held, count(*) AS both_hold
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n),
links AS (SELECT u, v FROM pairs WHERE 100 * both_hold >= 85 * all_held),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (
  SELECT r AS u, r AS v FROM different
  UNION
  SELECT reached.u, edges.v FROM reached JOIN edges ON reached.v = edges.u),
classes AS (SELECT u AS r, min(v) AS root FROM reached GROUP BY u),
rooted AS (
  SELECT s.r, s.doc_id, len(s.held) AS n_shingles, c.root
  FROM sets s LEFT JOIN different d ON s.held = d.held LEFT JOIN classes c ON c.r = d.r),
named AS (
  SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id
    ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id
  FROM rooted)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM named
"""


def centroids_sql(clusters: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """SQL for the clusters of ``embeddings``, with the given number of rounds one after the other."""
    parts = [
        f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
vector_parts AS (SELECT r, unnest(xs) AS x, generate_subscripts(xs, 1) AS d FROM vectors),
first AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, xs) - 1 AS c, xs
  FROM vectors QUALIFY c < {clusters}),
c0 AS (SELECT c, unnest(xs) AS x, generate_subscripts(xs, 1) AS d FROM first)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""
apart{i} AS (
  SELECT v.r, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance
  FROM vector_parts v JOIN c{i} c ON v.d = c.d GROUP BY v.r, c.c),
of{i} AS (
  SELECT r, c, distance FROM apart{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""
means{i} AS (
  SELECT o.c, v.d, sum(v.x) AS s, count(*) AS n FROM of{i} o JOIN vector_parts v ON v.r = o.r GROUP BY o.c, v.d),
c{i + 1} AS (
  SELECT c.c, c.d, CAST(coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS BIGINT) AS x
  FROM c{i} c LEFT JOIN means{i} m ON m.c = c.c AND m.d = c.d)"""
            )
    last = f"""
marks AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT v.vec_id, CAST(o.c AS INT) AS cluster, o.distance,
       CAST(sum(o.distance) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(o.distance) OVER () AS BIGINT) AS inertia, m.centroid_sha256
FROM of{rounds} o JOIN vectors v ON v.r = o.r JOIN marks m ON m.c = o.c
"""
    return ",".join([*parts, last])


CENTROIDS = centroids_sql()
