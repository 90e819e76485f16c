"""SQL twins (DuckDB) of the queries of this package that SQL can express."""

from __future__ import annotations

MIXING = """
WITH n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
     r AS (SELECT source, (1.0 / (SELECT count(*) FROM n))::DOUBLE * (SELECT sum(n_rows) FROM n) / n_rows AS mean FROM n),
     c AS (SELECT source, mean, greatest(1, ceil(mean / 32))::BIGINT AS chunks FROM r),
     k AS (SELECT source, chunks, unnest(range(0, ceil(mean / chunks + 12 * sqrt(mean / chunks) + 24)::BIGINT + 1)) AS k,
                  mean / chunks AS m FROM c),
     p AS (SELECT source, chunks, k, sum(exp(-m + CASE WHEN k = 0 THEN 0 ELSE k * ln(m) END - lgamma(k + 1)))
                  OVER (PARTITION BY source ORDER BY k) AS upto FROM k),
     d AS (SELECT doc_id, source, text, unnest(range(1, (SELECT max(chunks) FROM c) + 1)) AS draw FROM documents),
     u AS (SELECT doc_id, source, text, draw,
                  ('0x' || substr(md5('2026:' || coalesce(doc_id::VARCHAR, 'null') || ':draw:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM d),
     t AS (SELECT u.doc_id, u.source, u.text,
                  sum((SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.upto <= u.u AND u.draw <= p.chunks)) AS copies
           FROM u GROUP BY ALL),
     e AS (SELECT doc_id, source, text, unnest(range(1, copies::BIGINT + 1)) AS copy FROM t)
SELECT doc_id, source, text, copy::INTEGER AS copy,
       ('0x' || substr(md5('2026:' || coalesce(doc_id::VARCHAR, 'null') || ':place:' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS place
FROM e
"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

RANKING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  unnest(regexp_extract_all({_LOWER.format("text")}, '{_ALPHANUMERIC}')) AS term FROM documents),
     c AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
     s AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY ALL),
     a AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
     f AS (SELECT term, count(*)::BIGINT AS df FROM c GROUP BY ALL),
     i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_ALPHANUMERIC}')) AS term FROM benchmark),
     w AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM i JOIN f USING (term), a),
     x AS (SELECT item_id, doc_id, r,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM w JOIN c USING (term) JOIN s USING (r), a GROUP BY ALL),
     k AS (SELECT item_id, doc_id, score,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
           FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source FROM documents),
     t AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}')) AS term FROM d),
     v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
     z AS (SELECT lang, count(*) AS v FROM v GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
     m AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     l AS (SELECT lang, sum(total) AS total FROM m GROUP BY ALL),
     u AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
     q AS (SELECT u.lang, u.term, 1 + (1000000000 * (u.n + 5)::HUGEINT) // (l.total + 5 * z.v) AS q
           FROM u JOIN l USING (lang) JOIN z USING (lang)),
     p AS (SELECT m.lang, m.source, v.term, coalesce(c.n, 0) AS n,
                  1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (m.total + 5 * z.v) AS p
           FROM m JOIN v USING (lang) JOIN z USING (lang) LEFT JOIN c USING (lang, source, term)),
     pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
               FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
     every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
               FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
               LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
     terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
               FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
     both_parts AS (SELECT * FROM every UNION ALL SELECT * FROM terms),
     k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""


def oracle_queries() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op11_tileranking": RANKING, "op13_divergence": DIVERGENCE}
