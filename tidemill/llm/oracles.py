"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS ws
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS ws
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win))
),
hit AS (SELECT dw.doc_id, dw.k, dw.n, win.item FROM dw JOIN win ON win.n = dw.n AND win.ws = dw.ws),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

_RUN = "SELECT doc_id, pl, {n} AS n, list(line) OVER w AS run, sum(words) OVER w AS words FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY pl ROWS BETWEEN CURRENT ROW AND {m} FOLLOWING)"

#: Runs of 1 to 10 lines are listed. A longer run has ten words in any ten of its lines, each shifted alike, so it deletes what these delete.
OP8 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
c AS (SELECT *, len(regexp_extract_all(line, '[^ \t-\r]+')) AS words FROM l),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pl FROM c WHERE words > 0),
runs AS ({" UNION ALL ".join(_RUN.format(n=n, m=n - 1) for n in range(1, 11))}),
firsts AS (SELECT n, run, min({{'d': doc_id, 'p': pl}}) AS f FROM runs WHERE len(run) = n AND words >= 10 GROUP BY 1, 2 HAVING count(*) > 1),
later AS (SELECT r.doc_id, CASE WHEN f.d = r.doc_id THEN greatest(r.pl, f.p + r.n) ELSE r.pl END AS a, r.pl + r.n - 1 AS b FROM runs r JOIN firsts ON firsts.n = r.n AND firsts.run = r.run WHERE f.d <> r.doc_id OR f.p <> r.pl),
gone AS (SELECT DISTINCT h.doc_id, h.no FROM (SELECT doc_id, unnest(generate_series(a, b)) AS pl FROM later) g JOIN held h ON h.doc_id = g.doc_id AND h.pl = g.pl),
kept AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.no) AS text FROM c ANTI JOIN gone ON gone.doc_id = c.doc_id AND gone.no = c.no GROUP BY 1),
sums AS (SELECT c.doc_id, sum(CASE WHEN words > 0 THEN 1 ELSE 0 END)::BIGINT AS lines, count(g.no) AS deleted, sum(CASE WHEN g.no IS NOT NULL AND b.no IS NULL THEN 1 ELSE 0 END)::BIGINT AS runs
  FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.no = c.no LEFT JOIN gone b ON b.doc_id = c.doc_id AND b.no = c.no - 1 GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(sums.lines, 0) AS lines, coalesce(sums.deleted, 0) AS deleted, coalesce(sums.runs, 0) AS runs
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


def op5() -> str:
    """The counts, the references of all documents and the distances to them."""
    from .quality_rules import CLASSES, COMMON_WORDS, VOCABULARY, Limits

    limits = Limits()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    classes = ", ".join(f"length(regexp_replace(text, {quoted(p)}, '', 'g'))" for p in CLASSES.values())
    names = list(CLASSES)
    vocabulary = "[" + ", ".join(map(quoted, VOCABULARY)) + "]"
    langs = ", ".join(map(quoted, COMMON_WORDS))

    def distance(column: str, size: int) -> str:
        return f"""
  SELECT doc_id, min(sqrt(greatest(s / 2, 0))) AS d FROM (
    SELECT p.doc_id, r.lang, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + r)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(2 * r / (p + r)) ELSE 0 END) AS s
    FROM (SELECT doc_id, i, {column}[i] / greatest(list_sum({column}), 1) AS p FROM c, generate_series(1, {size}) g(i)) p
    JOIN (SELECT lang, i, sum({column}[i]) / sum(sum({column}[i])) OVER (PARTITION BY lang) AS r FROM c, generate_series(1, {size}) g(i) WHERE lang IN ({langs}) GROUP BY 1, 2) r ON r.i = p.i
    GROUP BY 1, 2) GROUP BY 1"""

    return f"""
WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, regexp_extract_all(text, '[^ \\t-\\r]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l, [{classes}] AS cl FROM b),
k AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw FROM f),
c AS (SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, (length(text) - cl[{names.index("space") + 1}])::BIGINT AS word_chars, cl[{names.index("symbol") + 1}]::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(text) AS n_chars,
  list_append(cl, length(text) - list_sum(cl)) AS chars, list_append(list_transform({vocabulary}, lambda v: len(list_filter(lw, lambda x: x = v))), len(w) - len(list_filter(lw, lambda x: list_contains({vocabulary}, x)))) AS common FROM k),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS ws FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM c)),
twin AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, ws) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twin) GROUP BY 1),
dc AS ({distance("chars", len(CLASSES) + 1)}),
dw AS ({distance("common", len(VOCABULARY) + 1)}),
a AS (SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words < {limits.least_words} OR 100 * coalesce(rep.n, 0) > {limits.repeat_percent} * n_words AS base_failed,
  CASE WHEN n_chars >= {limits.least_chars} THEN dc.d END AS char_distance, CASE WHEN n_words >= {limits.least_judged_words} THEN dw.d END AS word_distance
  FROM c LEFT JOIN rep ON rep.doc_id = c.doc_id LEFT JOIN dc ON dc.doc_id = c.doc_id LEFT JOIN dw ON dw.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(char_distance, 0) > {limits.chars} OR coalesce(word_distance, 0) > {limits.words}) AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM a
"""


def op11(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Lloyd's rounds in exact integers, written out; a centroid is a list."""
    parts = [f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT *, sha256('{seed}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {k})"""]
    near = "SELECT r, vec_id, v.v, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS m FROM v, {c} c GROUP BY ALL"
    for i in range(rounds):
        parts.append(f"""n{i} AS ({near.format(c=f"c{i}")}),
m{i} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n{i}) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS (SELECT c0.c, coalesce(m.v, c0.v) AS v FROM c{i} c0 LEFT JOIN m{i} m ON m.c = c0.c)""")
    parts.append(f"n AS ({near.format(c=f'c{rounds}')})")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM n JOIN c{rounds} c ON c.c = n.m.c"""


#: Every pair of rows is compared, so this is exact; the query finds at least 0.99 of the links (see the README).
OP12 = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM t WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
root AS (SELECT reach.a, min(t.vec_id) AS id FROM reach JOIN t ON t.r = reach.b GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, least(root.id, t.vec_id) AS component_id, least(root.id, t.vec_id) IS NOT DISTINCT FROM t.vec_id AS kept
FROM t LEFT JOIN n ON n.a = t.r LEFT JOIN root ON root.a = t.r
"""

OP13 = """
WITH t AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM t a JOIN t b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS w FROM s WHERE same) WHERE w <= 5),
n AS (SELECT p.a, p.w, p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.w ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
