"""Query rewriting: exclusions, spelling and the request gate."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import terms_of
from larder.operators.hooks import with_fallback
from larder.operators.skew import join_unique
from larder.session import materialise

# Fixed values.
NEGATION_WORDS = "without|no|except|excluding"
CLAUSE_ENDS = "for|with|in|on|using|but|please|that|to"
MIN_DF = 2
MIN_LENGTH = 4
MAX_DISTANCE = 2
KNOWN_SHARE = 0.5


def mark_clauses(query: Column) -> Column:
    """The query with ``~`` where an exclusion starts and ``|`` where one ends."""
    text = F.regexp_replace(F.lower(query), r"[^\p{L}\p{N},.;:!?\n]+", " ")
    text = F.regexp_replace(text, r"[.;:!?\n]+", " | ")
    text = F.regexp_replace(text, ",", " , ")
    text = F.concat(F.lit(" "), F.regexp_replace(text, " +", "  "), F.lit(" "))
    text = F.regexp_replace(text, f" ({CLAUSE_ENDS}) ", r" | $1 ")
    return F.regexp_replace(text, f" ({NEGATION_WORDS}) ", " ~ ")


def excluded_items(marked: Column) -> Column:
    """Items of all exclusion clauses; commas, or, and, nor part them."""
    clauses = F.regexp_extract_all(marked, F.lit("~([^~|]*)"), F.lit(1))
    items = F.flatten(F.transform(clauses, lambda c: F.split(c, " (?:or|and|nor) |,")))
    tidy = F.transform(items, lambda i: F.trim(F.regexp_replace(i, " +", " ")))
    return F.array_distinct(F.filter(tidy, lambda i: i != ""))


def kept_terms(marked: Column) -> Column:
    return terms_of(F.regexp_replace(marked, "~[^~|]*", " "))


def split_exclusions(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``kept``, the terms asked for, and ``excluded_ingredients``."""
    return (queries.withColumn("_marked", mark_clauses(F.col(query)))
            .withColumn("kept", kept_terms(F.col("_marked")))
            .withColumn("excluded_ingredients", excluded_items(F.col("_marked")))
            .drop("_marked"))


def _segment(size: str, i: str, parts: int) -> tuple[str, str]:
    """Start and length of segment ``i`` of a word of ``size`` letters cut into ``parts``."""
    longer = f"greatest(0, {i} - ({parts} - {size} % {parts}))"
    start = f"({i} * ({size} div {parts}) + {longer})"
    return start, f"({size} div {parts} + if({i} >= {parts} - {size} % {parts}, 1, 0))"


def _own_segments(term: str, distance: int) -> str:
    """Hashes of the segments of a word, with its length and their numbers."""
    start, size = _segment(f"length({term})", "i", distance + 1)
    return (f"transform(sequence(0, {distance}), i -> xxhash64(length({term}), i, "
            f"substr({term}, {start} + 1, {size})))")


def _possible_segments(term: str, distance: int) -> str:
    """Hashes of what the segments of a word at most ``distance`` edits away can be."""
    start, size = _segment("n", "i", distance + 1)
    shifts = (f"filter(sequence(-{distance}, {distance}), s -> {start} + s >= 0 "
              f"AND {start} + s + {size} <= length({term}))")
    each = (f"transform({shifts}, s -> xxhash64(n, i, "
            f"substr({term}, {start} + s + 1, {size})))")
    lengths = f"sequence(greatest(1, length({term}) - {distance}), length({term}) + {distance})"
    return (f"array_distinct(flatten(transform({lengths}, n -> "
            f"flatten(transform(sequence(0, {distance}), i -> {each})))))")


def corrections(unknown: DataFrame, vocabulary: DataFrame,
                max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``term, fix, distance``: the closest vocabulary term, then the most frequent.

    A word cut into one segment more than there are edits keeps one segment
    whole, moved by no more than the edits (Li et al. 2011, Pass-Join).  So an
    equi-join on segments finds all pairs, with a few keys a word whatever its
    length.
    """
    spark = unknown.sparkSession
    # few bytes, but much work on each: a number of parts that is given stays as it is
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    asked = unknown.select("term").repartition(parts, "term").distinct().select(
        "term", F.explode(F.expr(_possible_segments("term", max_distance))).alias("h"))
    offered = vocabulary.select(
        F.col("term").alias("fix"), "df",
        F.explode(F.expr(_own_segments("term", max_distance))).alias("h"))
    near = offered.join(asked, "h").withColumn(
        "distance", F.levenshtein("term", "fix", max_distance)).where(F.col("distance") >= 0)
    best = near.groupBy("term").agg(
        F.min(F.struct("distance", (-F.col("df")).alias("rarity"), "fix")).alias("best"))
    return best.select("term", "best.fix", "best.distance")


def look_up(words: DataFrame, term_df: DataFrame, min_df: int = MIN_DF,
            min_length: int = MIN_LENGTH) -> DataFrame:
    """``term, known, fix`` for every distinct term of ``words``.

    A term of the corpus is known, however rare, and never corrected.  Others
    get the closest term that ``min_df`` documents have, unless they are
    shorter than ``min_length``: two edits make any short word of any other.
    """
    distinct = materialise(words.select("term").distinct(), "words")
    marked = materialise(
        distinct.join(term_df.select("term", F.lit(True).alias("known")), "term", "left")
        .withColumn("known", F.coalesce("known", F.lit(False))), "known")
    unknown = marked.where(~F.col("known") & (F.length("term") >= min_length))
    if not unknown.limit(1).count():
        return marked.withColumn("fix", F.lit(None).cast("string"))
    fixes = corrections(unknown, term_df.where(F.col("df") >= min_df)).select("term", "fix")
    return materialise(marked.join(fixes, "term", "left"), "look-up")


def rewrite(queries: DataFrame, term_df: DataFrame, query: str = "query",
            min_share: float = KNOWN_SHARE) -> DataFrame:
    """One rewritten record per query, keyed by ``query_id``.

    A query is a request when at least ``min_share`` of its terms are in the
    corpus vocabulary.
    """
    parsed = materialise(split_exclusions(queries.select(
        F.monotonically_increasing_id().alias("number"), "query_id",
        F.col(query).alias("original_query")), "original_query"), "parsed")
    words = parsed.select("number", F.posexplode("kept").alias("pos", "term"))
    looked = join_unique(words, look_up(words, term_df), "term")
    # as many entries as the query has words
    rejoined = looked.groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("pos", "term", "known", "fix"))).alias("words"))
    built = parsed.join(rejoined, "number", "left").withColumn(
        "words", F.coalesce("words", F.expr("array()").cast(
            "array<struct<pos:int,term:string,known:boolean,fix:string>>")))
    fixed = F.filter("words", lambda w: w["fix"].isNotNull())
    corrected = F.array_distinct(F.transform(fixed, lambda w: F.concat(
        F.lit("Corrected "), w["term"], F.lit(" to "), w["fix"])))
    removed = F.transform("excluded_ingredients", lambda e: F.concat(F.lit("Excluded "), e))
    n_known = F.size(F.filter("words", lambda w: w["known"]))
    share = n_known / F.size("words")
    return built.select(
        "query_id",
        F.coalesce(F.when(F.size("words") > 0, share >= min_share), F.lit(False))
         .alias("is_recipe_request"),
        "original_query",
        F.array_join(F.transform("words", lambda w: F.coalesce(w["fix"], w["term"])), " ")
         .alias("adjusted_query"),
        "excluded_ingredients",
        F.concat(corrected, removed).alias("adjustments"),
        F.concat(n_known.cast("string"), F.lit(" of "), F.size("words").cast("string"),
                 F.lit(" words are known; "), F.size(corrected).cast("string"),
                 F.lit(" corrected; "), F.size("excluded_ingredients").cast("string"),
                 F.lit(" excluded")).alias("reasoning"))


REWRITTEN = ("query_id {key}, is_recipe_request boolean, original_query string, "
             "adjusted_query string, excluded_ingredients array<string>, "
             "adjustments array<string>, reasoning string")


def rewrite_by_model(queries: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame],
                     term_df: DataFrame, query: str = "query", **options) -> DataFrame:
    """``rewrite`` by a model: ``call`` gets ``query_id, query`` and returns the columns of
    ``rewrite``, and a text in ``error`` for those it rejects.  Requests that fail, or come
    back without a text, are rewritten by rule;
    ``answered_by`` names which it was.  ``options`` are those of ``call_model``.
    """
    asked = queries.select("query_id", F.col(query).alias("query"))
    schema = REWRITTEN.format(key=asked.schema["query_id"].dataType.simpleString())

    def checked(batch: pd.DataFrame) -> pd.DataFrame:
        answer = call(batch)
        blank = answer["adjusted_query"].isna()
        if "error" in answer:
            blank &= answer["error"].isna()
        if len(answer) != len(batch) or blank.any():
            raise ValueError("not a rewritten request for every request")
        return answer

    return with_fallback(asked, checked, schema, lambda rest: rewrite(rest, term_df), **options)


def gate(rewritten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to answer and requests turned away."""
    return (rewritten.where("is_recipe_request"), rewritten.where("NOT is_recipe_request"))
