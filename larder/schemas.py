"""Table schemas."""

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _B = T.TimestampType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_RECIPES = T.StructType([
    T.StructField("Title", _S), T.StructField("Instructions", _S),
    T.StructField("Image_Name", _S), T.StructField("Cleaned_Ingredients", _S)])

# The typed search table; no field may be null.
SEARCH_TABLE = T.StructType([
    T.StructField("index", _L, False), T.StructField("title", _S, False),
    T.StructField("cleaned_ingredients", _S, False),
    T.StructField("instructions", _S, False),
    T.StructField("image_name", _S, False),
    T.StructField("text_for_search", _S, False)])

VECTORS = T.StructType([
    T.StructField("index", _L, False),
    T.StructField("vec", T.ArrayType(T.FloatType(), False), False)])

PROMPTS = _struct(index=_L, title=_S, prompts=T.ArrayType(_S))

REWRITTEN = _struct(
    is_recipe_request=_B, original_query=_S, adjusted_query=_S,
    excluded_ingredients=T.ArrayType(_S), adjustments=T.ArrayType(_S), reasoning=_S)

ASSESSMENT = _struct(title=_S, is_relevant=_B, reason=_S, relevance_score=_I)

# The event log.  Every table carries its event time in ``ts``.
EVENT_LOG = {
    "user_feedback": _struct(id=_S, username=_S, recipe_title=_S, feedback=_S, ts=_TS),
    "user_sessions": _struct(session_id=_S, username=_S, ts=_TS),
    "user_queries": _struct(id=_S, session_id=_S, query=_S, ts=_TS),
    "retrieved_recipes": _struct(id=_S, query_id=_S, recipe_title=_S, score=_D, rank=_I, ts=_TS),
    "assessed_recipes": _struct(
        id=_S, query_id=_S, recipe_title=_S, is_relevant=_B, relevance_reason=_S,
        relevance_score=_I, ts=_TS),
    "recommended_recipes": _struct(id=_S, query_id=_S, recipe_title=_S, position=_I, ts=_TS),
    "user_clicks": _struct(id=_S, session_id=_S, recipe_title=_S, click_type=_S, ts=_TS),
    "query_adjustments": _struct(
        id=_S, session_id=_S, original_query=_S, adjusted_query=_S,
        excluded_ingredients=T.ArrayType(_S), ts=_TS),
    "bad_image_feedback": _struct(id=_S, username=_S, recipe_title=_S, ts=_TS),
}

# child table, foreign key, parent table, parent key
FOREIGN_KEYS = [
    ("user_queries", "session_id", "user_sessions", "session_id"),
    ("user_clicks", "session_id", "user_sessions", "session_id"),
    ("query_adjustments", "session_id", "user_sessions", "session_id"),
    ("retrieved_recipes", "query_id", "user_queries", "id"),
    ("assessed_recipes", "query_id", "user_queries", "id"),
    ("recommended_recipes", "query_id", "user_queries", "id"),
]
