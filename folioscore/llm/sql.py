"""DuckDB SQL with the same rows as the registered queries, over whole tables."""

from __future__ import annotations

from .textblocks import SEPARATORS

_SEP = SEPARATORS[:-1]
_WORD = "[^" + _SEP[1:]

#: Words of a text, in lower case.
WORDS = f"regexp_extract_all(lower(text), '{_WORD}+')"


def _windows(table: str, key: str) -> str:
    sizes = ", ".join(f"string_agg(w, ' ') OVER (PARTITION BY {key}, text ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS p{n}" for n in (5, 6, 7, 8))
    return f"""
{table}_t AS (SELECT {key}, text, regexp_extract_all(text, '{_SEP}*{_WORD}+') AS t FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)),
{table}_u AS (SELECT {key}, text, len(t) AS n, unnest(t) AS tk, unnest(range(len(t))) AS k FROM {table}_t),
{table}_v AS (SELECT {key}, text, n, k, regexp_replace(tk, '^{_SEP}+', '') AS raw, sum(length(tk)) OVER (PARTITION BY {key}, text ORDER BY k) AS e FROM {table}_u),
{table}_w AS (SELECT *, lower(raw) AS w, e - length(raw) AS s FROM {table}_v),
{table}_p AS (SELECT {key}, text, n, k, s, e, {sizes} FROM {table}_w)"""


SQL = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, list_sort(CASE WHEN len(t) >= 5 THEN list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, len(t) - 3)]) ELSE [array_to_string(t, ' ')] END) AS g FROM w WHERE len(t) > 0),
v AS (SELECT row_number() OVER (ORDER BY doc_id, g) AS v, doc_id, len(g) AS n, g FROM d),
s AS (SELECT v, n, unnest(g) AS g FROM v),
c AS (SELECT a.v AS a, b.v AS b, a.n + b.n AS n, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.v <> b.v GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE c / (n - c) >= 0.4),
r(v, x) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.x),
k AS (SELECT r.v, min(doc_id) AS class_id FROM r JOIN v ON v.v = r.x GROUP BY r.v),
n AS (SELECT a AS v, count(*) AS links FROM e GROUP BY a)
SELECT v.doc_id, k.class_id, n.links FROM v JOIN k USING (v) JOIN n USING (v)""",
    "op2_exact_dedup": """
WITH g AS (SELECT text, min(doc_id) AS keep_id, count(DISTINCT doc_id) AS copies FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text)
SELECT DISTINCT d.doc_id, g.keep_id, g.copies FROM documents d JOIN g ON d.text = g.text WHERE g.copies > 1 AND d.doc_id <> g.keep_id""",
    "op4_lm_score": f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT rid, doc_id, w, k, CASE WHEN k >= 1 THEN lag(w, 1) OVER o END AS v, CASE WHEN k >= 2 THEN lag(w, 2) OVER o END AS u FROM (SELECT rid, doc_id, unnest(t) AS w, unnest(range(len(t))) AS k FROM r) WINDOW o AS (PARTITION BY rid ORDER BY k)),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM w WHERE k >= 1 GROUP BY v, w HAVING count(*) >= 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM w WHERE k >= 2 GROUP BY u, v, w HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM w),
x AS (SELECT a.rid, a.k, t.c AS c3, p.c AS cp, b.c AS c2, q.c AS cq, o.c AS c1 FROM w a
  LEFT JOIN c3 t ON t.u = a.u AND t.v = a.v AND t.w = a.w LEFT JOIN c2 p ON p.v = a.u AND p.w = a.v
  LEFT JOIN c2 b ON b.v = a.v AND b.w = a.w LEFT JOIN c1 q ON q.w = a.v JOIN c1 o ON o.w = a.w),
s AS (SELECT rid, count(*) AS n_words, sum(CASE WHEN c3 IS NOT NULL THEN ln(c3) - ln(cp) WHEN c2 IS NOT NULL THEN ln(c2) - ln(cq) + CASE WHEN k >= 2 THEN ln(0.4) ELSE 0 END ELSE ln(c1) - ln(n.n) + least(k, 2) * ln(0.4) END) AS l,
  count(c3) AS by_trigram, count(CASE WHEN c3 IS NULL THEN c2 END) AS by_bigram FROM x, n GROUP BY rid)
SELECT r.doc_id, coalesce(n_words, 0) AS n_words, coalesce(round(l, 4), 0.0) AS log_score, coalesce(round(l / n_words, 4), 0.0) AS mean_log_score, coalesce(by_trigram, 0) AS by_trigram, coalesce(by_bigram, 0) AS by_bigram, coalesce(n_words - by_trigram - by_bigram, 0) AS by_unigram
FROM r LEFT JOIN s USING (rid)""",
    "op8_decontamination": f"""
WITH {_windows("documents", "doc_id")},{_windows("benchmark", "item_id")},
pattern AS (SELECT DISTINCT item_id, least(n, 8) AS size, CASE least(n, 8) WHEN 5 THEN p5 WHEN 6 THEN p6 WHEN 7 THEN p7 ELSE p8 END AS p FROM benchmark_p WHERE n >= 5 AND k + least(n, 8) <= n),
hit AS (
  SELECT d.doc_id, d.text, p.item_id, d.k AS a, d.k + p.size - 1 AS b FROM documents_p d JOIN pattern p ON p.p = d.p8 AND p.size = 8 AND d.k + 8 <= d.n
  UNION ALL SELECT d.doc_id, d.text, p.item_id, d.k, d.k + 6 FROM documents_p d JOIN pattern p ON p.p = d.p7 AND p.size = 7 AND d.k + 7 <= d.n
  UNION ALL SELECT d.doc_id, d.text, p.item_id, d.k, d.k + 5 FROM documents_p d JOIN pattern p ON p.p = d.p6 AND p.size = 6 AND d.k + 6 <= d.n
  UNION ALL SELECT d.doc_id, d.text, p.item_id, d.k, d.k + 4 FROM documents_p d JOIN pattern p ON p.p = d.p5 AND p.size = 5 AND d.k + 5 <= d.n),
edge AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, text, item_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM hit),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, text, item_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM edge),
span AS (SELECT doc_id, text, item_id, min(a) AS first_word, max(b) AS last_word FROM isle GROUP BY doc_id, text, item_id, g)
SELECT DISTINCT x.doc_id, x.item_id, x.first_word, x.last_word, CAST(f.s AS BIGINT) AS start, CAST(l.e AS BIGINT) AS "end"
FROM span x JOIN documents_w f ON f.doc_id = x.doc_id AND f.text = x.text AND f.k = x.first_word JOIN documents_w l ON l.doc_id = x.doc_id AND l.text = x.text AND l.k = x.last_word""",
}
