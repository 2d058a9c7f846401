"""The registered queries in plain SQL over the given tables.

Each is put together from named steps: a step is one common table expression.
"""

from __future__ import annotations

TERMS = r"[\p{L}\p{N}]+"


def terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TERMS}')"


def with_(steps: list[str], select: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + select


# Inputs

DOCUMENTS = "docs AS (SELECT doc_id AS index, text FROM documents)"

RECIPES = """
recipes AS (
  SELECT p_partkey AS index, p_name AS title, p_type AS instructions,
         CAST(p_partkey AS VARCHAR) AS image_name,
         [p_brand, p_type, p_type || ' ' || p_name] AS ingredients,
         '[''' || p_brand || ''', ''' || p_type || ''', ''' || p_type || ' ' || p_name || ''']'
           AS cleaned_ingredients
  FROM part),
docs AS (
  SELECT *, title || '. Ingredients: ' || array_to_string(ingredients, ', ')
            || '. Instructions: ' || instructions AS text
  FROM recipes)"""

TURNS = """
turns AS (
  SELECT conv_id || '-' || turn AS query_id, text AS query,
         make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS ts
  FROM conversations WHERE role = 'user')"""

PASSAGES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

REQUESTS = TURNS + """,
queries AS (
  SELECT md5(query) AS query_id, query FROM (
    SELECT p_name || ' without ' || lower(p_type) AS query FROM part
    UNION SELECT substr(p_name, 1, 2) || substr(p_name, 4) FROM part
    UNION SELECT query FROM turns))"""

# Full-text search

COUNTS = f"""
lens AS (SELECT index, len({terms('text')}) AS doc_len FROM docs),
tfs AS (
  SELECT index, term, count(*) AS tf
  FROM (SELECT index, unnest({terms('text')}) AS term FROM docs) GROUP BY index, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
stats AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens)"""


def bm25(k: int, queries: str = "queries", name: str = "found") -> str:
    return f"""
{name}_terms AS (
  SELECT DISTINCT query_id, term
  FROM (SELECT query_id, unnest({terms('query')}) AS term FROM {queries})),
{name}_scores AS (
  SELECT query_id, t.index, count(*) AS matched,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM {name}_terms q JOIN tfs t USING (term) JOIN dfs USING (term)
       JOIN lens l ON l.index = t.index CROSS JOIN stats
  GROUP BY query_id, t.index),
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index) AS rank
    FROM {name}_scores) WHERE rank <= {k})"""


# Vectors

DISTANCES = {
    "l2": "array_distance({a}, {b})",
    "cosine": "1 - array_cosine_similarity({a}, {b})",
    "dot": "-array_inner_product({a}, {b})",
}


def knn(metric: str, k: int, queries: str, vectors: str, name: str) -> str:
    distance = DISTANCES[metric].format(a="q.vec", b="v.vec")
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT query_id, index, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY distance, index) AS rank
    FROM (SELECT query_id, index, round({distance}, 6) + 0.0 AS distance
          FROM {queries} q CROSS JOIN {vectors} v)) WHERE rank <= {k})"""


def hashed(texts: str, key: str, text: str, name: str) -> str:
    """Vectors of ``texts`` as ``name`` and their entries as ``name_entries``."""
    return f"""
{name}_weights AS (
  SELECT {key}, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 256 AS bucket,
         sum((1 - 2 * (CAST('0x' || substr(md5(term), 5, 1) AS INT) % 2)) * length(term)
             * ln(1 + tf)) AS w
  FROM (SELECT {key}, term, count(*) AS tf
        FROM (SELECT {key}, unnest({terms(text)}) AS term FROM {texts}) GROUP BY ALL)
  GROUP BY ALL),
{name}_entries AS (
  SELECT l.{key}, b.bucket, CAST(round(coalesce(w, 0) / len, 6) AS FLOAT) AS weight
  FROM (SELECT {key}, sqrt(sum(w * w)) AS len FROM {name}_weights GROUP BY {key}
        HAVING len > 1e-9) l
  CROSS JOIN (SELECT unnest(range(256)) AS bucket) b
  LEFT JOIN {name}_weights w ON w.{key} = l.{key} AND w.bucket = b.bucket),
{name} AS (
  SELECT {key}, CAST(list(weight ORDER BY bucket) AS DOUBLE[256]) AS vec
  FROM {name}_entries GROUP BY {key})"""


def fused(parts: tuple[str, str], k: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index) AS rank
    FROM (SELECT query_id, index, round(sum(1e0 / (60 + rank)), 6) AS score
          FROM (SELECT query_id, index, rank FROM {parts[0]}
                UNION ALL SELECT query_id, index, rank FROM {parts[1]})
          GROUP BY query_id, index)) WHERE rank <= {k})"""


def vector_search(metric: str) -> str:
    return with_([
        "vectors AS (SELECT vec_id AS index, CAST(embedding AS DOUBLE[64]) AS vec FROM embeddings)",
        "asked AS (SELECT index AS query_id, vec FROM vectors)",
        knn(metric, 5, "asked", "vectors", "near")],
        "SELECT query_id, rank, index, distance FROM near")


# Prompts

PROMPTS = """
weighed AS (
  SELECT index, term, row_number() OVER (PARTITION BY index ORDER BY
           round(tf * ln((1e0 + n) / (1 + df)), 6) DESC, term) AS place
  FROM (SELECT *, max(length(term)) OVER (PARTITION BY index) AS longest FROM tfs)
  JOIN dfs USING (term) CROSS JOIN stats WHERE length(term) > 2 OR longest <= 2),
prompts AS (
  SELECT index || '-' || variant AS query_id, index, variant,
         string_agg(term, ' ' ORDER BY hash, term) AS query
  FROM (SELECT index, variant, term, hash,
               row_number() OVER (PARTITION BY index, variant ORDER BY hash, term) AS spot
        FROM (SELECT index, variant, term, md5(index || ':' || variant || ':' || term) AS hash
              FROM weighed CROSS JOIN (SELECT unnest(range(1, 6)) AS variant) WHERE place <= 8))
  WHERE spot <= 3 + CAST('0x' || substr(md5(index || ':' || variant), 1, 4) AS INT) % 3
  GROUP BY index, variant)"""

METHODS = [
    DOCUMENTS, COUNTS, PROMPTS,
    hashed("docs", "index", "text", "vectors"),
    hashed("prompts", "query_id", "query", "asked"),
    knn("l2", 50, "asked", "vectors", "l2"),
    knn("cosine", 5, "asked", "vectors", "cosine"),
    bm25(50, "prompts", "text_found"),
    fused(("text_found", "l2"), 5, "fused"),
    """
results AS (
  SELECT 'flat_l2' AS method, 1 AS method_order, query_id, index, rank FROM l2 WHERE rank <= 5
  UNION ALL SELECT 'vector_cosine', 2, query_id, index, rank FROM cosine
  UNION ALL SELECT 'full_text', 3, query_id, index, rank FROM text_found WHERE rank <= 5
  UNION ALL SELECT 'hybrid', 4, query_id, index, rank FROM fused)""",
    """
metrics AS (
  SELECT method, method_order, """ + ", ".join(
        f"round(avg(CASE WHEN hit <= {k} THEN 1e0 / hit ELSE 0e0 END), 6) AS mrr_{k}, "
        f"round(avg(CASE WHEN hit <= {k} THEN 1e0 ELSE 0e0 END), 6) AS recall_{k}"
        for k in (1, 3, 5)) + """
  FROM (SELECT m.method, m.method_order, r.rank AS hit
        FROM prompts p CROSS JOIN (SELECT DISTINCT method, method_order FROM results) m
        LEFT JOIN results r ON r.method = m.method AND r.query_id = p.query_id
                               AND r.index = p.index)
  GROUP BY method, method_order)""",
]

# Rewriting

ACCENTED = "ßàáâäæçèéêëìíîïñòóôöùúûüœ"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:len(ACCENTED)]


def letters(term: str) -> str:
    """``levenshtein`` counts bytes here: give every accented letter one of its own."""
    return f"translate({term}, '{ACCENTED}', '{PLAIN}')"


SPLIT = rf"""
marked AS (
  SELECT query_id, query,
    regexp_replace(regexp_replace(
      ' ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        lower(query), '[^\p{{L}}\p{{N}},.;:!?\n]+', ' ', 'g'),
        '[.;:!?\n]+', ' | ', 'g'), ',', ' , ', 'g'), ' +', '  ', 'g') || ' ',
      ' (for|with|in|on|using|but|please|that|to) ', ' | \1 ', 'g'),
      ' (without|no|except|excluding) ', ' ~ ', 'g') AS marked
  FROM queries),
items AS (
  SELECT query_id, item, min(spot) AS spot FROM (
    SELECT query_id, trim(regexp_replace(item, ' +', ' ', 'g')) AS item, spot FROM (
      SELECT query_id, unnest(pieces) AS item, generate_subscripts(pieces, 1) AS spot FROM (
        SELECT query_id, flatten(list_transform(regexp_extract_all(marked, '~([^~|]*)', 1),
          lambda c: regexp_split_to_array(c, ' (?:or|and|nor) |,'))) AS pieces
        FROM marked)))
  WHERE item <> '' GROUP BY query_id, item),
excluded AS (
  SELECT query_id, list(item ORDER BY spot) AS excluded FROM items GROUP BY query_id),
parsed AS (
  SELECT query_id, query, {terms("regexp_replace(marked, '~[^~|]*', ' ', 'g')")} AS kept,
         coalesce(excluded, CAST([] AS VARCHAR[])) AS excluded
  FROM marked LEFT JOIN excluded USING (query_id))"""

LOOK_UP = f"""
words AS (
  SELECT query_id, unnest(kept) AS term, generate_subscripts(kept, 1) AS pos FROM parsed),
vocabulary AS (SELECT term, df FROM dfs WHERE df >= 2),
marks AS (
  SELECT w.term, v.term IS NOT NULL AS known
  FROM (SELECT DISTINCT term FROM words) w LEFT JOIN dfs v USING (term)),
near AS (
  SELECT u.term, v.term AS fix, v.df,
         levenshtein({letters('u.term')}, {letters('v.term')}) AS distance
  FROM marks u JOIN vocabulary v
    ON length(v.term) BETWEEN length(u.term) - 2 AND length(u.term) + 2
  WHERE NOT u.known AND length(u.term) >= 4),
fixes AS (
  SELECT term, fix FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, df DESC, fix) AS place
    FROM near WHERE distance <= 2) WHERE place = 1),
look_up AS (SELECT term, known, fix FROM marks LEFT JOIN fixes USING (term))"""

REWRITE = LOOK_UP + """,
rejoined AS (
  SELECT query_id, count(*) AS n_words, count(*) FILTER (known) AS n_known,
         string_agg(coalesce(fix, term), ' ' ORDER BY pos) AS adjusted
  FROM words JOIN look_up USING (term) GROUP BY query_id),
corrected AS (
  SELECT query_id, list(note ORDER BY pos) AS notes FROM (
    SELECT query_id, 'Corrected ' || term || ' to ' || fix AS note, min(pos) AS pos
    FROM words JOIN look_up USING (term) WHERE fix IS NOT NULL GROUP BY ALL)
  GROUP BY query_id),
rewritten AS (
  SELECT p.query_id, p.query AS original_query, coalesce(adjusted, '') AS adjusted_query,
         p.excluded, coalesce(n_known * 1e0 / n_words >= 0.5, false) AS is_recipe_request,
         list_concat(coalesce(notes, CAST([] AS VARCHAR[])),
                     list_transform(p.excluded, lambda e: 'Excluded ' || e)) AS adjustments,
         coalesce(n_known, 0) || ' of ' || coalesce(n_words, 0) || ' words are known; '
           || coalesce(len(notes), 0) || ' corrected; ' || len(p.excluded) || ' excluded'
           AS reasoning
  FROM parsed p LEFT JOIN rejoined USING (query_id) LEFT JOIN corrected USING (query_id))"""

REWRITTEN = """
SELECT query_id, is_recipe_request, adjusted_query, array_to_string(excluded, '|') AS excluded,
       array_to_string(adjustments, '|') AS adjustments, reasoning{more}
FROM rewritten"""

# Assessment


def assessed(queries: str, recipes: str) -> str:
    """``queries`` has query and excluded; ``recipes`` has text and ingredients."""
    return f"""
judged AS (
  SELECT f.query_id, f.index, f.rank, f.score, r.title,
         list_distinct({terms('q.query')}) AS asked, {terms('r.text')} AS there,
         list_filter(q.excluded, lambda e: list_contains(
           list_transform(r.ingredients, lambda g: lower(g)), lower(e))) AS exact,
         list_filter(q.excluded, lambda e: len(list_filter(r.ingredients,
           lambda g: contains(lower(g), lower(e)))) > 0) AS touched
  FROM found f JOIN {queries} q USING (query_id) JOIN {recipes} r ON r.index = f.index),
counted AS (
  SELECT *, len(list_intersect(asked, there)) AS hits, len(asked) AS n,
         list_filter(touched, lambda e: NOT list_contains(exact, e)) AS partial
  FROM judged),
assessed AS (
  SELECT *, greatest(0, least(10, CAST(floor(coalesce(10e0 * hits / nullif(n, 0), 0) + 0.5) AS INT)
             - 5 * len(exact) - 3 * len(partial))) AS relevance_score,
         'Matches ' || hits || ' of ' || n || ' query terms'
         || CASE WHEN len(exact) > 0
                 THEN '; contains excluded ' || array_to_string(exact, ', ') ELSE '' END
         || CASE WHEN len(partial) > 0
                 THEN '; excluded within an ingredient ' || array_to_string(partial, ', ')
                 ELSE '' END AS reason
  FROM counted),
best AS (
  SELECT * FROM (
    SELECT query_id, index, relevance_score, row_number() OVER (
             PARTITION BY query_id ORDER BY relevance_score DESC, rank) AS position
    FROM assessed WHERE relevance_score >= 5) WHERE position <= 3)"""


REQUEST_STEPS = [
    RECIPES, COUNTS, REQUESTS, SPLIT, REWRITE,
    """
answered AS (
  SELECT query_id, adjusted_query AS query, excluded FROM rewritten WHERE is_recipe_request)""",
    bm25(10, "answered"), assessed("answered", "docs")]

DOCUMENT_STEPS = [
    DOCUMENTS, COUNTS, PASSAGES, SPLIT,
    """
answered AS (
  SELECT query_id, array_to_string(kept, ' ') AS query,
         CASE WHEN list_contains(excluded, kept[1]) OR len(kept) = 0 THEN excluded
              ELSE list_append(excluded, kept[1]) END AS excluded
  FROM parsed)""",
    """
corpus AS (
  SELECT index, CAST(index AS VARCHAR) AS title, text, ingredients
  FROM docs JOIN (SELECT index, list(term) AS ingredients FROM tfs GROUP BY index) USING (index))""",
    bm25(10, "answered"), assessed("answered", "corpus")]

LABELLED = """
labelled AS (
  SELECT d.doc_id AS index, quality = 1 AS is_relevant, toxic, quality,
         5 * quality + CASE WHEN toxic = 0 THEN 3 ELSE 0 END + d.doc_id % 3 AS label_score,
         CASE WHEN length(text) > 5000 THEN 4 ELSE 0 END AS extra
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# Event log

TIME = "strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"

ACTIONS = """
actions AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id,
         json_extract_string(props, '$.k') AS recipe_title, props AS comment, value,
         CASE event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'like'
              WHEN 'error' THEN 'dislike' WHEN 'click' THEN 'comment'
              ELSE CASE WHEN value > 50 THEN 'bad_image' ELSE 'view_ingredients' END END AS action
  FROM events)"""

LOG = [
    ACTIONS,
    """
feedback AS (
  SELECT CAST(event_id AS VARCHAR) AS id, session_id AS username, recipe_title,
         CASE action WHEN 'like' THEN 'Liked' WHEN 'dislike' THEN 'Disliked' ELSE comment END
           AS feedback, ts
  FROM actions WHERE action IN ('like', 'dislike', 'comment'))""",
    """
clicked AS (
  SELECT CAST(event_id AS VARCHAR) AS id, session_id, recipe_title,
         CASE action WHEN 'like' THEN 'Liked' WHEN 'dislike' THEN 'Disliked'
              WHEN 'comment' THEN 'Detailed Feedback' WHEN 'bad_image' THEN 'Bad Image'
              ELSE 'View Ingredients' END AS click_type, ts
  FROM actions WHERE action <> 'login')""",
    "bad AS (SELECT * FROM actions WHERE action = 'bad_image')",
    """
started AS (
  SELECT session_id, min(ts) AS ts FROM actions WHERE action = 'login' GROUP BY session_id)""",
]


def log(select: str) -> str:
    return with_(LOG, select)


def top_recipes(kind: str, n: int) -> str:
    return log(f"SELECT recipe_title, count(*) AS count FROM feedback WHERE feedback = '{kind}' "
               f"GROUP BY recipe_title ORDER BY count DESC, recipe_title LIMIT {n}")


def most_frequent(table: str, column: str) -> str:
    return (f"(SELECT {column} FROM {table} GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


FEEDBACK_ROWS = f"SELECT id, username, recipe_title, feedback, {TIME.format(ts='ts')} AS ts FROM feedback"
CLICK_ROWS = f"SELECT id, session_id, recipe_title, click_type, {TIME.format(ts='ts')} AS ts FROM clicked"
ASKED = """
asked AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS session_id,
         o_orderpriority AS query, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS ts,
         c_name AS username
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

STREAM_VISITS = with_([ACTIONS, """
steps AS (
  SELECT session_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE
                                   OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM actions WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
stretches AS (
  SELECT session_id, ts, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts) AS stretch
  FROM steps),
visits AS (
  SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n
  FROM stretches GROUP BY session_id, stretch)"""],
    f"""SELECT session_id, {TIME.format(ts='start')} AS start, {TIME.format(ts='"end"')} AS "end", n
FROM visits WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM actions)""")

LIST_TEXT = """
SELECT p_partkey,
  CASE WHEN p_size <= 10 THEN '[''' || p_brand || ''', ''' || p_type || ''']'
       WHEN p_size <= 18 THEN '["' || p_brand || '''s", ''' || p_type || ''']'
       WHEN p_size <= 24 THEN '[''' || p_brand || '\\''s "best"'', ''' || p_type || ''']'
       WHEN p_size <= 30 THEN '[''\\xbd ' || p_brand || ''', ''caf\\u00e9 ' || p_type || ''']'
       WHEN p_size <= 35 THEN '[''' || p_brand || ''', None]'
       WHEN p_size <= 40 THEN 'nan'
       WHEN p_size <= 45 THEN '[''' || p_brand || ''',]'
       ELSE '[]' END AS written,
  CASE WHEN p_size <= 10 THEN p_brand || '|' || p_type
       WHEN p_size <= 18 THEN p_brand || '''s|' || p_type
       WHEN p_size <= 24 THEN p_brand || '''s "best"|' || p_type
       WHEN p_size <= 30 THEN '½ ' || p_brand || '|café ' || p_type
       WHEN p_size <= 40 THEN NULL
       WHEN p_size <= 45 THEN p_brand ELSE '' END AS items,
  CASE WHEN p_size > 30 AND p_size <= 40 THEN 'rejected' ELSE 'ok' END AS status
FROM part""".replace("\\\\", "\\")

NUMBERED = ("array_to_string(list_transform(ingredients, lambda g, i: i || '. ' || g), chr(10))")

ORACLES = {
    "fts_top10": with_([DOCUMENTS, COUNTS, PASSAGES, bm25(10)],
                       "SELECT query_id, rank, index, score, matched FROM found"),
    "fts_pruned_top10": with_([DOCUMENTS, COUNTS, PASSAGES, bm25(10)],
                              "SELECT query_id, rank, index, score, matched FROM found"),
    "fts_turns_top10": with_([DOCUMENTS, COUNTS, TURNS, bm25(10, "turns")],
                             "SELECT query_id, rank, index, score, matched FROM found"),
    "fts_index_stats": with_([DOCUMENTS, COUNTS], """
SELECT count(*) AS n_docs, CAST(sum(doc_len) AS BIGINT) AS n_terms,
       round(avg(doc_len), 6) AS avg_len, max(doc_len) AS max_len FROM lens"""),
    "fts_postings": with_([DOCUMENTS, COUNTS], """
SELECT term, index, tf, doc_len, df FROM tfs JOIN dfs USING (term) JOIN lens USING (index)"""),
    "retrieve_recipes": with_([
        RECIPES, COUNTS,
        "queries AS (SELECT DISTINCT p_name AS query_id, p_name AS query FROM part)",
        bm25(10)], f"""
SELECT query_id, rank, index, score, title, {NUMBERED} AS ingredients, instructions,
       'data/Food_Images/' || image_name || '.jpg' AS image_path
FROM found JOIN docs USING (index)"""),
    "ingest_search_text": with_([RECIPES], """
SELECT row_number() OVER (ORDER BY index) - 1 AS index, title, text AS text_for_search,
       title || ' ' || cleaned_ingredients || ' ' || instructions AS text_for_embedding,
       3 AS n_ingredients, false AS has_gaps FROM docs"""),
    "ingest_csv": with_([RECIPES], """
SELECT title, text || chr(10) || chr(10) || '"Serve",' || chr(10) || 'warm.' AS text_for_search,
       3 AS n_ingredients FROM docs"""),
    "ingredients_numbered": with_([RECIPES], f"""
SELECT index, {NUMBERED} AS numbered,
       'data/Food_Images/' || image_name || '.jpg' AS image_path FROM recipes"""),
    "list_text_quarantine": LIST_TEXT,
    "knn_l2_top5": vector_search("l2"),
    "knn_cosine_top5": vector_search("cosine"),
    "knn_dot_top5": vector_search("dot"),
    "knn_approximate_top5": vector_search("cosine"),  # the same where every neighbour is found
    "knn_approximate_recall": f"""
SELECT count(*) AS n_true, true AS reached FROM ({vector_search('cosine')})""",
    "embed_hashed": with_([DOCUMENTS, hashed("docs", "index", "text", "vectors")], """
SELECT index, bucket, round(CAST(weight AS DOUBLE), 5) + 0.0 AS weight FROM vectors_entries"""),
    "hybrid_rrf_top5": with_([
        DOCUMENTS, COUNTS, PASSAGES, hashed("docs", "index", "text", "vectors"),
        hashed("queries", "query_id", "query", "asked"), knn("l2", 50, "asked", "vectors", "l2"),
        bm25(50), fused(("found", "l2"), 5, "fused")],
        "SELECT query_id, rank, index, score FROM fused"),
    "eval_results": with_(METHODS, "SELECT method, query_id, rank, index FROM results"),
    "eval_methods": with_(METHODS, "SELECT * FROM metrics"),
    "eval_best": with_(METHODS + ["""
long AS (
  UNPIVOT metrics ON mrr_1, recall_1, mrr_3, recall_3, mrr_5, recall_5
  INTO NAME metric VALUE value),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, method_order) = 1
              AS is_best FROM long)"""], """
SELECT metric, method, value, is_best,
       format('{:.2f}', value) || CASE WHEN is_best THEN ' *' ELSE '' END AS shown
FROM marked"""),
    "prompts_known_item": with_([DOCUMENTS, COUNTS, PROMPTS],
                                "SELECT query_id, index, variant, query FROM prompts"),
    "prompts_negation": with_([DOCUMENTS, COUNTS, PROMPTS, """
frequent AS (
  SELECT term, row_number() OVER (ORDER BY df DESC, term) AS place
  FROM dfs WHERE length(term) > 2),
absent AS (
  SELECT index, list(term ORDER BY place) AS absent FROM (
    SELECT docs.index, f.term, f.place,
           row_number() OVER (PARTITION BY docs.index ORDER BY f.place) AS spot
    FROM docs CROSS JOIN (SELECT * FROM frequent WHERE place <= 200 + (
      SELECT max(m) FROM (SELECT count(*) AS m FROM tfs GROUP BY index))) f
    LEFT JOIN tfs t ON t.index = docs.index AND t.term = f.term WHERE t.term IS NULL)
  WHERE spot <= 200
  GROUP BY index)"""], """
SELECT query_id, index, variant, query || ' without ' || absent[1 +
         CAST('0x' || substr(md5(query_id), 1, 4) AS INT) % len(absent)] AS query
FROM prompts JOIN absent USING (index)"""),
    "sample_seeded": with_([DOCUMENTS, COUNTS, PROMPTS, """
listed AS (
  SELECT index, list(query ORDER BY variant) AS prompts FROM prompts GROUP BY index),
sampled AS (
  SELECT * FROM listed ORDER BY md5('42:' || index), index LIMIT 200)"""], """
SELECT index, n_chars, CAST(to_json(prompts) AS VARCHAR) AS prompts
FROM sampled JOIN documents ON doc_id = index"""),
    "rewrite_negation": with_([REQUESTS, SPLIT], """
SELECT query_id, array_to_string(kept, ' ') AS kept,
       array_to_string(excluded, '|') AS excluded FROM parsed"""),
    "rewrite_spelling": with_([
        DOCUMENTS, COUNTS, TURNS, "queries AS (SELECT query_id, query FROM turns)", SPLIT, LOOK_UP],
        "SELECT term, known, fix FROM look_up"),
    "rewrite_gate": with_([DOCUMENTS, COUNTS, PASSAGES, SPLIT, REWRITE], REWRITTEN.format(more="")),
    "rewrite_model": with_([RECIPES, COUNTS, REQUESTS, SPLIT, REWRITE], REWRITTEN.format(
        more=", 'rules' AS answered_by") + """
WHERE original_query NOT LIKE '% without %'
UNION ALL
SELECT query_id, true, split_part(query, ' without ', 1), item, 'Excluded ' || item,
       'one exclusion', 'model'
FROM (SELECT *, substr(query, strpos(query, ' without ') + 9) AS item FROM queries)
WHERE query LIKE '% without %'"""),
    "rewrite_requests": with_([RECIPES, COUNTS, REQUESTS, SPLIT, REWRITE], REWRITTEN.format(more=""",
       'Adjusted query: ' || adjusted_query || chr(10) || chr(10)
       || CASE WHEN len(adjustments) > 0 THEN 'Adjustments made:' || chr(10) ||
            array_to_string(list_transform(adjustments, lambda a: '- ' || a), chr(10)) ELSE '' END
       || CASE WHEN len(excluded) > 0 THEN chr(10) || chr(10) || 'Excluded ingredients:' || chr(10)
            || array_to_string(list_transform(excluded, lambda e: '- ' || e), chr(10)) ELSE '' END
         AS summary""")),
    "assess_score": with_(DOCUMENT_STEPS, """
SELECT query_id, index, relevance_score, relevance_score >= 5 AS is_relevant FROM assessed"""),
    "recommend_documents": with_(DOCUMENT_STEPS, """
SELECT query_id, position, index, relevance_score FROM best"""),
    "assess_requests": with_(REQUEST_STEPS, """
SELECT query_id, index, title, relevance_score >= 5 AS is_relevant, reason, relevance_score
FROM assessed"""),
    "exclusion_hits": with_(REQUEST_STEPS + ["""
pairs AS (
  SELECT query_id, index, unnest(a.excluded) AS excluded, ingredients
  FROM found JOIN answered a USING (query_id) JOIN docs USING (index)),
named AS (
  SELECT query_id, index, excluded, unnest(ingredients) AS ingredient FROM pairs)"""], """
SELECT query_id, index, excluded, ingredient,
       CASE WHEN lower(ingredient) = lower(excluded) THEN 'exact' ELSE 'partial' END AS kind
FROM named WHERE contains(lower(ingredient), lower(excluded))"""),
    "assess_prompt": with_(REQUEST_STEPS + [f"""
blocks AS (
  SELECT query_id, string_agg(
    'Recipe ' || rank || ':' || chr(10) || 'Title: ' || title || chr(10) || 'Ingredients: '
    || {NUMBERED} || chr(10) || 'Instructions: ' || instructions,
    chr(10) || chr(10) ORDER BY rank) AS blocks
  FROM found JOIN docs USING (index) GROUP BY query_id)"""], """
SELECT query_id, 'Query: ' || query || chr(10) || 'Excluded Ingredients: '
       || array_to_string(excluded, ', ') || chr(10) || chr(10) || 'Recipes:' || chr(10) || blocks
         AS message
FROM blocks JOIN answered USING (query_id)"""),
    "assessment_check": with_([LABELLED], """
SELECT index, label_score + extra AS relevance_score,
       CASE WHEN quality IS NULL THEN 'missing is_relevant'
            WHEN label_score + extra NOT BETWEEN 0 AND 10 THEN 'score out of range'
            ELSE 'valid' END AS verdict FROM labelled"""),
    "combine_labels": with_([DOCUMENTS, COUNTS, TURNS, bm25(10, "turns"), LABELLED], """
SELECT * FROM (
  SELECT query_id, row_number() OVER (
           PARTITION BY query_id ORDER BY label_score DESC, rank) AS position,
         index, label_score AS relevance_score
  FROM found JOIN labelled USING (index) WHERE is_relevant AND label_score >= 7)
WHERE position <= 3"""),
    "recommend_top3": with_(REQUEST_STEPS,
                            "SELECT query_id, position, index, relevance_score FROM best"),
    "stream_recommend": with_(REQUEST_STEPS,
                              "SELECT query_id, position, index, relevance_score FROM best"),
    "recommend_status": with_(REQUEST_STEPS + ["""
outcome AS (
  SELECT query_id, count(b.query_id) AS recommendations,
         CASE WHEN NOT any_value(is_recipe_request) THEN 'rejected'
              WHEN count(b.query_id) = 0 THEN 'empty' ELSE 'recommended' END AS status
  FROM rewritten LEFT JOIN best b USING (query_id) GROUP BY query_id)"""], """
SELECT query_id, status, recommendations, CASE status
  WHEN 'rejected' THEN 'Sorry, your query doesn''t seem to be a recipe request. '
    || 'Please try again with a recipe-related query.'
  WHEN 'empty' THEN 'No matching recipes found. Please try a different query.' END AS message
FROM outcome"""),
    "query_trace": with_(REQUEST_STEPS, """
SELECT query_id, 'query' AS stage, CAST(NULL AS INT) AS place, CAST(NULL AS VARCHAR) AS recipe,
       CAST(NULL AS DOUBLE) AS score FROM answered
UNION ALL SELECT query_id, 'retrieved', rank, CAST(index AS VARCHAR), score FROM found
UNION ALL SELECT query_id, 'assessed', rank, CAST(index AS VARCHAR), relevance_score FROM assessed
UNION ALL SELECT query_id, 'recommended', position, CAST(index AS VARCHAR), relevance_score
FROM best"""),
    "feedback_stats": log("""
SELECT count(*) AS total_feedback,
       CAST(sum(CASE WHEN feedback = 'Liked' THEN 1 ELSE 0 END) AS BIGINT) AS likes,
       CAST(sum(CASE WHEN feedback = 'Disliked' THEN 1 ELSE 0 END) AS BIGINT) AS dislikes,
       CAST(sum(CASE WHEN feedback NOT IN ('Liked', 'Disliked') THEN 1 ELSE 0 END) AS BIGINT)
         AS detailed_feedback
FROM feedback"""),
    "feedback_totals": log("""
SELECT count(*) FILTER (feedback = 'Liked') AS likes,
       count(*) FILTER (feedback = 'Disliked') AS dislikes FROM feedback"""),
    "feedback_bars": log("""
SELECT 'Likes' AS metric, count(*) FILTER (feedback = 'Liked') AS count FROM feedback
UNION ALL SELECT 'Dislikes', count(*) FILTER (feedback = 'Disliked') FROM feedback
UNION ALL SELECT 'Bad Image Reports', count(*) FROM bad"""),
    "bad_images": log("SELECT count(*) AS bad_image_reports FROM bad"),
    "most_liked": top_recipes("Liked", 10),
    "top_liked": top_recipes("Liked", 3),
    "top_disliked": top_recipes("Disliked", 3),
    "report_range": log("""
SELECT strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date
FROM (SELECT ts FROM feedback UNION ALL SELECT ts FROM bad)"""),
    "score_hist": with_([LABELLED], """
SELECT score, count(label_score) AS n
FROM (SELECT unnest(range(11)) AS score) LEFT JOIN labelled ON label_score = score
GROUP BY score"""),
    "score_kde": with_([LABELLED, """
sized AS (
  SELECT count(*) AS n, stddev_samp(label_score) * pow(count(*), -0.2e0) AS width,
         min(label_score) AS low, max(label_score) AS high
  FROM labelled WHERE label_score IS NOT NULL),
counts AS (
  SELECT label_score AS s, count(*) AS c FROM labelled WHERE label_score IS NOT NULL GROUP BY s),
points AS (
  SELECT point, low + (high - low) * point / 199e0 AS x, n, width
  FROM sized CROSS JOIN (SELECT unnest(range(200)) AS point))"""], """
SELECT point, round(x, 6) AS x,
       round(sum(c * exp(-0.5e0 * pow((x - s) / width, 2))) / (n * width * sqrt(2 * pi())), 6)
         AS density
FROM points CROSS JOIN counts GROUP BY point, x, n, width"""),
    "all_feedback": log(FEEDBACK_ROWS),
    "feedback_by_user": log(
        f"{FEEDBACK_ROWS} WHERE username = {most_frequent('feedback', 'username')}"),
    "feedback_by_recipe": log(
        f"{FEEDBACK_ROWS} WHERE recipe_title = {most_frequent('feedback', 'recipe_title')}"),
    "clicks": log(CLICK_ROWS),
    "clicks_by_session": log(
        f"{CLICK_ROWS} WHERE session_id = {most_frequent('clicked', 'session_id')}"),
    "click_counts": log("SELECT click_type, count(*) AS n FROM clicked GROUP BY click_type"),
    "user_queries": with_([ASKED], "SELECT id, session_id, query, ts, username FROM asked"),
    "user_queries_by_session": with_([ASKED], f"""
SELECT id, session_id, query, ts FROM asked
WHERE session_id = {most_frequent('asked', 'session_id')}"""),
    "user_queries_by_name": with_([ASKED], f"""
SELECT id, session_id, query, ts FROM asked
WHERE username = {most_frequent('asked', 'username')}"""),
    "recent_adjustments": with_([
        DOCUMENTS, COUNTS, TURNS, "queries AS (SELECT query_id, query FROM turns)", SPLIT, REWRITE], f"""
SELECT query_id AS id, {TIME.format(ts='ts')} AS ts, original_query, adjusted_query,
       CAST(to_json(excluded) AS VARCHAR) AS excluded_ingredients,
       '**Timestamp:** ' || {TIME.format(ts='ts')} || chr(10) || chr(10)
       || '**Original Query:** **' || original_query || '**' || chr(10) || chr(10)
       || '**Adjusted Query:** **' || adjusted_query || '**' || chr(10) || chr(10)
       || '**Excluded Ingredients:** ' || array_to_string(excluded, ', ') || chr(10) || chr(10)
       || '---' || chr(10) || chr(10) AS digest
FROM rewritten JOIN turns USING (query_id) ORDER BY turns.ts DESC, query_id DESC LIMIT 10"""),
    "session_activity": log(f"""
SELECT session_id, {TIME.format(ts='min(ts)')} AS first_activity,
       {TIME.format(ts='max(ts)')} AS last_activity, count(*) AS actions
FROM (SELECT session_id, ts FROM started
      UNION ALL SELECT session_id, ts FROM clicked WHERE click_type NOT LIKE 'View%'
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderdate AS TIMESTAMP) FROM orders)
GROUP BY session_id"""),
    "log_key_audit": log(" UNION ALL ".join(f"""
SELECT '{child}.{key}' AS link, key, count(*) AS child_rows
FROM (SELECT CAST({column} AS VARCHAR) AS key FROM {table})
WHERE key IS NOT NULL AND key NOT IN (SELECT {parent}) GROUP BY key"""
        for child, key, table, column, parent in (
            ("user_queries", "session_id", "orders", "o_custkey", "session_id FROM started"),
            ("user_clicks", "session_id", "clicked", "session_id", "session_id FROM started"),
            ("query_adjustments", "session_id", "conversations", "conv_id",
             "session_id FROM started"),
            ("retrieved_recipes", "query_id", "lineitem", "l_orderkey",
             "CAST(o_orderkey AS VARCHAR) FROM orders"),
            ("assessed_recipes", "query_id", "labels", "doc_id",
             "CAST(o_orderkey AS VARCHAR) FROM orders"),
            ("recommended_recipes", "query_id", "benchmark", "item_id",
             "CAST(o_orderkey AS VARCHAR) FROM orders")))),
    "orphan_audit": " UNION ALL ".join(f"""
SELECT '{child}.{key}' AS link, CAST({key} AS VARCHAR) AS key, count(*) AS child_rows
FROM {child} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent}) GROUP BY {key}"""
        for child, key, parent, parent_key in (
            ("orders", "o_custkey", "customer", "c_custkey"),
            ("labels", "doc_id", "pages", "page_id"),
            ("customer", "c_custkey", "orders", "o_custkey"),
            ("events", "user_id", "supplier", "s_suppkey"))),
    "missing_images": """
SELECT 'data/Food_Images/' || p_partkey || '.jpg' AS image_path, p_partkey AS index,
       p_name AS title
FROM part WHERE p_partkey NOT IN (SELECT page_id FROM pages)""",
    "stream_feedback_daily": with_([ACTIONS], """
SELECT strftime(ts, '%Y-%m-%d') AS day, action AS kind, count(*) AS n FROM actions
GROUP BY ALL"""),
    "stream_sessions": with_([ACTIONS], f"""
SELECT session_id, {TIME.format(ts='min(ts)')} AS first_ts, {TIME.format(ts='max(ts)')} AS last_ts,
       count(*) AS n FROM actions GROUP BY session_id"""),
    "stream_visits": STREAM_VISITS,
    "stream_dedup": f"""
SELECT event_id, {TIME.format(ts='ts')} AS ts, user_id, event_type, props FROM events""",
    "stream_log": log(f"""
SELECT 'user_sessions' AS log_table, count(*) AS n, {TIME.format(ts='max(ts)')} AS last_ts
FROM started
UNION ALL SELECT 'user_feedback', count(*), {TIME.format(ts='max(ts)')} FROM feedback
UNION ALL SELECT 'user_clicks', count(*), {TIME.format(ts='max(ts)')} FROM clicked
UNION ALL SELECT 'bad_image_feedback', count(*), {TIME.format(ts='max(ts)')} FROM bad"""),
}
