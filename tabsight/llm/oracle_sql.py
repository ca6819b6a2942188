"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

def _vector_codes(rounds: int = 6) -> str:
    """Assignments and codebooks of every round as chained tables of single numbers."""
    steps = ["""
        kept AS (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) % 8 = 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (
            SELECT vec_id, (i - 1) // (len(embedding) // 8) AS part, (i - 1) % (len(embedding) // 8) AS place,
                   floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
        ), firsts AS (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16
        ), c0 AS MATERIALIZED (
            SELECT part, entry, place, x AS c FROM x JOIN firsts USING (vec_id)
        )"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, part, entry, apart FROM (
                SELECT vec_id, x.part, entry, sum((x - c) * (x - c))::BIGINT AS apart
                FROM x JOIN c{r} c ON c.part = x.part AND c.place = x.place GROUP BY ALL
            ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY apart, entry) = 1
        )""")
        if r < rounds:
            steps.append(f"""m{r} AS (
            SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL
        ), c{r + 1} AS MATERIALIZED (
            SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
            FROM c{r} LEFT JOIN m{r} USING (part, entry, place)
        )""")
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error
            FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)
    """


ORACLE: dict[str, str] = {
    "op4_mixing": """
        WITH docs AS (
            SELECT doc_id, source, coalesce(text, '') AS text, coalesce(source, '') AS s FROM documents
        ), rates AS (
            SELECT s, 1.0::DOUBLE / (SELECT count(DISTINCT s) FROM docs) * (SELECT count(*) FROM docs) / count(*) AS rate
            FROM docs GROUP BY s
        ), terms AS (
            SELECT s, k, exp(-rate) * list_product([rate / i FOR i IN range(1, k + 1)]::DOUBLE[] || [1.0::DOUBLE]) AS term
            FROM rates, range(0, 121) AS r(k)
        ), sums AS (
            SELECT s, k, sum(term) OVER (PARTITION BY s ORDER BY k) AS cdf FROM terms
        ), drawn AS (
            SELECT *, ('0x' || substr(md5(concat_ws(':', '0', doc_id, md5(text), '1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM docs
        ), counted AS (
            SELECT d.doc_id, d.source, d.text, count(x.k) AS n FROM drawn d JOIN sums x ON x.s = d.s AND x.cdf <= d.u GROUP BY ALL
        ), copies AS (
            SELECT doc_id, source, text, unnest(range(0, n))::INTEGER AS copy FROM counted
        )
        SELECT doc_id, source, copy, md5(concat_ws(':', '0', 'order', doc_id, md5(text), copy)) AS shuffle_key, md5(text) AS text_md5
        FROM copies
    """,
    "op11_vector_codes": _vector_codes(),
    "op12_source_divergence": """
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), words AS MATERIALIZED (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
        ), kept AS MATERIALIZED (
            SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
        ), langs AS (
            SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
        ), cells AS MATERIALIZED (
            SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN cells USING (lang, source) GROUP BY ALL
        ), shares AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v)::HUGEINT AS p,
                   1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v)::HUGEINT AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)
        ), valued AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value,
               (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM valued QUALIFY part = 'pair' OR rank <= 200
    """,
    "op5_ball_tree": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS whole FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), found AS (
            SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.whole, c.whole))::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.whole) = len(q.whole) WHERE q.vec_id % 20 = 0 GROUP BY ALL
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM found QUALIFY rank <= 20
    """,
    "op6_sorted_passes": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT DISTINCT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_cosine_similarity(a.x, b.x) >= 0.95
        ), reach AS (
            SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.node
        ), parts AS (
            SELECT node, min(root) AS component_id FROM reach GROUP BY node
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN parts ON node = vec_id
    """,
    "op10_ngram_jaccard": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS MATERIALIZED (
            SELECT u, w FROM (SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
            JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = w WHERE 100 * shared >= 90 * (x.n + y.n - shared)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.node
        ), parts AS (
            SELECT node, min(root) AS component_id FROM reach GROUP BY node
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN parts ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
}
