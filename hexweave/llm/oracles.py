"""DuckDB SQL for the operators that SQL can express: archives' records, license scans, near-duplicate documents."""

from __future__ import annotations

from hexweave.llm import divergence, licenses, minhash, warc

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_SMALL}')"


RECORDS = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN m ON payload_digest = d AND payload_bytes >= {warc.REVISIT_BYTES}"""

DOCUMENTS = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {minhash.WIDTH}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {minhash.WIDTH - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {minhash.PERCENT} * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id, least(w.doc_id, coalesce(least, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN g ON g.a = w.doc_id"""


def licenses_sql(threshold: float = licenses.THRESHOLD) -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    stop = ", ".join(f"'{s}'" for s in licenses.STOP)
    templates = ", ".join(f"('{label}', '{text}', {licenses.reach(label)})" for label, text in licenses.TEMPLATES.items())
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) AS w FROM documents),
phrase(p, label) AS (VALUES {phrases}),
hit AS MATERIALIZED (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrase WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM hit GROUP BY 1),
template AS MATERIALIZED (SELECT label, reach, list_distinct(list_filter(regexp_extract_all({_lower("t")}, {words}), lambda x: x NOT IN ({stop}))) AS want FROM (VALUES {templates}) AS v(label, t, reach)),
line AS (SELECT doc_id, list_distinct(regexp_extract_all({_lower("of")}, {words})) AS held FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS of FROM documents)),
met AS (SELECT doc_id, label, len(list_intersect(want, held)) AS n, len(want) AS size FROM line, template),
said AS MATERIALIZED (SELECT doc_id, i - 1 AS place, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN (SELECT unnest(want) FROM template)),
own AS MATERIALIZED (SELECT doc_id, label, reach, len(want) AS size, place, token FROM said JOIN template ON list_contains(want, token)),
run AS (SELECT a.doc_id, a.label, count(DISTINCT b.token) AS n, a.size FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.label = b.label AND b.place BETWEEN a.place AND a.place + a.reach - 1 GROUP BY a.doc_id, a.label, a.place, a.size),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size::DOUBLE) AS best FROM (SELECT doc_id, label, n, size FROM met UNION ALL SELECT doc_id, label, n, size FROM run) WHERE n >= ceil({threshold} * size - 1e-9) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN more ON more.doc_id = w.doc_id"""


def divergence_sql(least_docs: int = divergence.LEAST_DOCS, top: int = divergence.TOP) -> str:
    def probability(count: str, total: str) -> str:
        return f"1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v)"

    def gap(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang::VARCHAR, '') AS lang, coalesce(source::VARCHAR, '') AS source, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS l FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS s FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {probability("coalesce(n, 0)", "s")} AS p, {probability("total", "l")} AS q FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum({gap("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {gap("p", "q")} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM part QUALIFY part = 'pair' OR rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": RECORDS, "op12_divergence": divergence_sql(), "op6_license_scan": licenses_sql(), "op7_minhash": DOCUMENTS}
