"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from .licences import TEMPLATES

_BITS = ", ".join(
    f"sum((h{i} >> {s}) & 1)::BIGINT AS b{i}_{s}" for i in range(2) for s in range(60)
)
# Lanes stand in the order of the operator: by hash, by shift below 20, by counter.
_LANES = ", ".join(
    f"((2 * coalesce(b{i}_{s + 20 * k}, 0) - n) % 65536 + 65536) % 65536" for i in range(2) for s in range(20) for k in range(3)
)
_SIGNED = "list_transform({}, lambda x: (x + 32768) % 65536 - 32768)"


def _likeness(a: str, b: str) -> str:
    apart = f"list_transform(range(1, 121), lambda i: ((({a}[i] - {b}[i]) % 65536 + 65536) % 65536 + 32768) % 65536 - 32768)"
    square = "list_sum(list_transform({}, lambda x: (x * x)::BIGINT))::BIGINT".format
    whole = f"({square(_SIGNED.format(a))} + {square(_SIGNED.format(b))})"
    return f"CASE WHEN {whole} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {square(apart)}::DOUBLE / {whole}::DOUBLE) END"


FINGERPRINTS = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS total FROM documents
), e AS (
  SELECT a.doc_id, a.r, a.r % a.total + 1 AS following, length(a.text)::BIGINT AS n_chars, a.text,
         substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.total + 1
), v AS (
  SELECT r, 0 AS version, text FROM e UNION ALL SELECT r, 1, edited FROM e
), p AS (
  SELECT r, version, unnest(regexp_extract_all(text, '[^\\n.!?]*[\\n.!?]+|[^\\n.!?]+')) AS p FROM v
), h AS (
  SELECT r, version, ('0x' || substr(md5(p), 1, 15))::BIGINT AS h0, ('0x' || substr(md5(p), 16, 15))::BIGINT AS h1 FROM p
), s AS (
  SELECT r, version, count(*)::BIGINT AS n, {_BITS} FROM h GROUP BY r, version
), l AS (
  SELECT v.r, v.version, n, [{_LANES}] AS lanes
  FROM (SELECT v.r, v.version, coalesce(n, 0) AS n, s.* EXCLUDE (r, version, n) FROM v LEFT JOIN s ON v.r = s.r AND v.version = s.version) v
), f AS (
  SELECT r, version, lanes,
         lpad(upper(format('{{:x}}', n)), 8, '0') || array_to_string(list_transform(lanes, lambda x: lpad(upper(format('{{:x}}', x)), 4, '0')), '') AS print
  FROM l
)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, o.print AS fingerprint, n.print AS edited_fingerprint,
       {_likeness('o.lanes', 'n.lanes')} AS near_edited, {_likeness('o.lanes', 'x.lanes')} AS near_next
FROM e JOIN f o ON o.r = e.r AND o.version = 0 JOIN f n ON n.r = e.r AND n.version = 1
JOIN f x ON x.r = e.following AND x.version = 0
"""


ARCHIVES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hash FROM pages
), w AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY hash) AS newest,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hash, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM w
"""

_WORDS = r"string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _bigrams(text: str) -> str:
    words = _WORDS.format(text)
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def _templates() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return f"SELECT * FROM (VALUES {rows}) t(licence, text)"


LICENCES = f"""
WITH t AS (
  SELECT licence, wanted, list_filter(wanted, lambda p: regexp_matches(p, '[0-9]')) AS numbered
  FROM (SELECT licence, {_bigrams("text")} AS wanted FROM ({_templates()}))
), u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS unit FROM documents
  UNION ALL SELECT doc_id, text, -1 FROM documents WHERE contains(text, chr(10))
), w AS (
  SELECT doc_id, unit, {_WORDS.format("line")} AS w FROM u WHERE line <> ''
), b AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS found FROM w WHERE len(w) > 1
), m AS (
  SELECT doc_id, unit, licence, len(list_intersect(found, wanted)) * 2 / (len(found) + len(wanted)) AS dice
  FROM b, t WHERE len(list_intersect(found, wanted)) * 2 / (len(found) + len(wanted)) >= 0.8 AND list_has_all(found, numbered)
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence) = 1
), o AS (
  SELECT doc_id, count(DISTINCT unit)::BIGINT AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
         max(dice) AS best_dice, min(licence) FILTER (dice = top) AS best
  FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id) AS top FROM m) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences, best, best_dice
FROM documents d LEFT JOIN o USING (doc_id)
"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS units
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.units, c.units)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

LEXICAL_SEARCH = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS term FROM documents
), f AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), a AS (
  SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM n
), q AS (
  SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licences": LICENCES,
        "op6_archives": ARCHIVES,
        "op10_fingerprints": FINGERPRINTS,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_lexical_search": LEXICAL_SEARCH,
    }
