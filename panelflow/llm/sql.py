"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The smallest id that every id of node(id) reaches over the links of link(u, v).
_REACH = """
sym AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(id, x) AS (SELECT id, id FROM node UNION SELECT reach.id, sym.v FROM reach JOIN sym ON sym.u = reach.x),
comp AS (SELECT id, min(x) AS component_id FROM reach GROUP BY id)"""

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
node AS (SELECT doc_id AS id, len(s) AS n FROM sets),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id > b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common WHERE 100 * c >= 75 * (nu + nv - c)),{_REACH}
SELECT id AS doc_id, n::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM node JOIN comp USING (id)
"""

OP4 = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
-- blocks of 4000 starts, as reading a place of a long string takes time by its distance
blocks AS (
  SELECT doc_id, b, substr(h, 8000 * b + 1, 8798) AS part, len(h) // 2 - 400 - 4000 * b AS last
  FROM (SELECT *, unnest(range(0, greatest(0, (len(h) // 2 - 400) // 4000 + 1))) AS b FROM docs WHERE len(h) >= 800)),
strings AS (
  SELECT doc_id, 4000 * b + i AS a, md5(substr(part, 2 * i + 1, 800)) AS m
  FROM (SELECT *, unnest(range(0, least(4000, last + 1))) AS i FROM blocks)),
twice AS (SELECT m FROM strings GROUP BY m HAVING count(*) > 1),
hits AS (SELECT doc_id, a FROM strings SEMI JOIN twice USING (m)),
marked AS (SELECT *, coalesce(a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 400, true) AS new FROM hits),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM marked),
runs AS (SELECT doc_id, run, min(a) AS a, max(a) + 400 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS rest,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS before
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    coalesce(before, '') || substr(h, 2 * coalesce(rest, 0) + 1) AS k
  FROM docs LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(k)) AS kept_sha256, (len(k) // 2)::BIGINT AS n_kept
FROM kept
"""

OP6 = f"""
WITH RECURSIVE vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),
node AS (
  SELECT id, v, v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0 AS fine FROM vectors),
link AS (
  SELECT a.id AS u, b.id AS v FROM node a JOIN node b ON a.id > b.id AND a.fine AND b.fine AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),{_REACH},
degree AS (SELECT u AS id, count(*) AS n FROM sym GROUP BY u)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM node JOIN comp USING (id) LEFT JOIN degree USING (id)
"""



def _op12(rounds: int = 3) -> str:
    """Rounds unrolled; the floor of a negative mean is taken by the remainder, as whole-number division rounds towards 0."""
    dot = "list_sum(list_transform(range(1, 65), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))::BIGINT"
    near = f"SELECT v.id, v.x, arg_min(c.c, {{{{'d': {dot.format('v.x', 'c.x')}, 'c': c.c}}}}) AS c FROM v CROSS JOIN {{0}} c GROUP BY v.id, v.x"
    out = """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
v AS MATERIALIZED (SELECT id, list_transform(f, lambda a: floor(64 * a)::BIGINT) AS x FROM e WHERE len(list_filter(f, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || id)) - 1)::INT AS c, x FROM v ORDER BY sha256('1:' || id) LIMIT 16)"""
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED ({near.format(f"c{r}")}),
s{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"""
    return out + f""",
a AS ({near.format(f"c{rounds}")}),
d AS (SELECT id, a.c, {dot.format('a.x', 'c.x')} AS distance, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (c))
SELECT id AS vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM d"""


OP12 = _op12()

#: The others tokenize, learn or fit; tests hold them against brute force, round trips or held-out accuracy.
ORACLES: dict[str, str] = {"op2_minhash": OP2, "op4_suffixes": OP4, "op6_embeddings": OP6, "op12_centroids": OP12}
