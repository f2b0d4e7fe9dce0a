"""DuckDB SQL for the corpus queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from tidemark.llm import decontaminate, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
 s AS (SELECT item, w, least({decontaminate.WINDOW}, len(w)) AS size FROM b WHERE len(w) > 0),
 windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
 grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS said FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM s))),
 hits AS (SELECT doc_id, item, i, size FROM grams JOIN windows USING (size, said)),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _has(term: str) -> str:
    return rf"CAST(regexp_matches(said, '(^|[^\p{{L}}\p{{N}}]){term}($|[^\p{{L}}\p{{N}}])') AS INTEGER)"


def _fits(host: str, start: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}'))"


_BY_LENGTH = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
URL_FILTER = f"""WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS said, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, said, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
 h AS (SELECT page_id, said, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p),
 j AS (SELECT *, CASE {' '.join(f"WHEN {_fits(a, b)} THEN '{a + b}'" for a, b, _ in _BY_LENGTH)} END AS rule, {' + '.join(f'{w} * {_has(t)}' for t, w in urls.read_terms())} AS weight FROM h)
 SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{a + b}' THEN '{v}'" for a, b, v in urls.RULES)} WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM j"""

EMBEDDING_DUPLICATES = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
 c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
 SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""



def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


LEXICAL_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, {_terms('text')} AS w FROM documents) WHERE len(w) > 0),
 c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
 p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
 g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs),
 q AS (SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL),
 s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN g USING (term) JOIN p USING (term), c GROUP BY ALL)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

ORACLE_SQL = {
    "op4_decontamination": DECONTAMINATION,
    "op6_url_filter": URL_FILTER,
    "op8_embedding_duplicates": EMBEDDING_DUPLICATES,
    "op12_lexical_search": LEXICAL_SEARCH,
}
