"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# All documents against each other over common shingles, then the least id of each component.
NEAR_DUPLICATES = f"""
WITH RECURSIVE
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                                    '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    END AS s
  FROM worded),
shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
classes AS (SELECT list_sort(s) AS members, min(doc_id) AS class_id FROM sets
            WHERE len(s) > 0 GROUP BY ALL)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, coalesce(class_id, sets.doc_id) AS class_id,
       component_id, sets.doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id) LEFT JOIN classes ON list_sort(s) = members
"""

_QUINT = "('0x' || substr(sha1(payload), 5 * i + 1, 5))::BIGINT"
_DIGIT = " || ".join(f"substr('{BASE32}', (({_QUINT} >> {shift}) & 31)::INT + 1, 1)"
                     for shift in (15, 10, 5, 0))

WARC = f"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
largest AS (SELECT payload, max(page_id) AS kept_id FROM pages_ GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: {_DIGIT}), '') AS payload_digest,
       CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept_id THEN kept_id END AS refers_to
FROM pages_ JOIN largest USING (payload)
"""

REPEATS = f"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
spans AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM worded WHERE len(w) >= 50),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS span FROM spans),
least AS (SELECT span, min(doc_id) AS first_id FROM hashed GROUP BY span),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
  FROM hashed JOIN least USING (span) WHERE first_id < doc_id),
removed AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, len(coalesce(places, [])) AS m,
         list_filter(w, lambda x, i: NOT list_contains(coalesce(places, []), i)) AS k
  FROM worded LEFT JOIN removed USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))),
                         1, 15))::BIGINT AS draw
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
         2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM totals),
ranked AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
                                    AND 1 PRECEDING), 0) AS before_,
         sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM (SELECT *, row_number() OVER (
          ORDER BY source_size / weight, encode(source) NULLS LAST) AS place FROM weighed)),
fitted AS (SELECT *, cap * left_ <= weight * (budget - before_) AS fits FROM ranked),
shared AS (
  SELECT arg_max(budget - before_, left_) AS spare, max(left_) AS weights
  FROM fitted WHERE NOT fits),
targets AS (
  SELECT source, source_size,
         CASE WHEN fits THEN cap::DOUBLE ELSE weight * spare / weights END AS target
  FROM fitted, shared),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start_
  FROM sized),
epochs AS (
  SELECT doc_id, size, source_size, target, start_, floor(target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, words - whole * source_size - start_)))::BIGINT AS taken
FROM epochs
"""

# All documents that share a term with an item, scored in full.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                            '{TERM}') AS t
  FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
counts AS (
  SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM docs),
tfs AS (SELECT r, doc_id, n, term, count(*) AS tf FROM counts GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
weighed AS (
  SELECT i, item_id, term,
         floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM asked JOIN dfs USING (term), totals),
scored AS (
  SELECT i, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (
           100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term), totals GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 50
"""

# All vectors against all, then the least id of each component.
VECTOR_LINKS = """
WITH RECURSIVE
usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id,
       vec_id = component_id AS kept, 1.0::DOUBLE AS audit_recall
FROM least LEFT JOIN counted USING (vec_id)
"""

ORACLES: dict[str, str] = {
    "op3_minhash_neardup": NEAR_DUPLICATES,
    "op4_warc": WARC,
    "op7_substring_dedup": REPEATS,
    "op9_mixing": MIXING,
    "op12_vector_graph": VECTOR_LINKS,
    "op13_nra_search": RANKED,
}
