from pyspark.sql import functions as F

from larder.functions import text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def parsed(spark, value):
    return one(spark, text.parse_list_text(F.col("t")), t=value)


def test_list_text(spark):
    assert parsed(spark, """['1 cup flour', "chef's salt"]""") == ["1 cup flour", "chef's salt"]
    assert parsed(spark, r"""['it\'s "hot"', 'b']""") == ['it\'s "hot"', "b"]
    assert parsed(spark, r"""['\xbd cup', 'café']""") == ["½ cup", "café"]
    assert parsed(spark, "[]") == []
    assert parsed(spark, "['a',]") == ["a"]
    for bad in ("['a', None]", "nan", "", "['a'", None, "{'a': 1}"):
        assert parsed(spark, bad) is None


def test_escaped_backslash_is_no_escape(spark):
    assert parsed(spark, r"['a\\xbd']") == [r"a\xbd"]


def test_terms(spark):
    assert one(spark, text.terms_of(F.col("t")), t="Crème brûlée, 2 eggs!") == [
        "crème", "brûlée", "2", "eggs"]
    assert one(spark, text.terms_of(F.col("t")), t=None) == []


def test_numbered(spark):
    assert one(spark, text.numbered_text(F.col("l")), l=["x", "y"]) == "1. x\n2. y"
    assert one(spark, text.numbered_text(F.col("l")), l=[]) == ""


def test_search_and_embedding_text(spark):
    composed = text.search_text(F.col("t"), F.col("l"), F.col("i"))
    assert one(spark, composed, t="Soup", l=["a", "b"], i="Cook") == (
        "Soup. Ingredients: a, b. Instructions: Cook")
    assert one(spark, composed, t=None, l=["a"], i=None) == ". Ingredients: a. Instructions: "
    joined = text.embedding_text(F.col("t"), F.col("r"), F.col("i"))
    assert one(spark, joined, t="Soup", r="['a']", i="Cook") == "Soup ['a'] Cook"
    assert one(spark, joined, t="Soup", r=None, i="Cook") is None


def test_labels(spark):
    assert one(spark, text.image_path(F.col("n")), n="pie") == "data/Food_Images/pie.jpg"
    assert one(spark, text.view_label(F.col("n")), n="Instructions") == "View Instructions"
    shown = text.detail_text(F.col("d"), F.lit("ing"), F.lit("ins"))
    assert [one(spark, shown, d=d) for d in ("Ingredients", "Instructions", "Other")] == [
        "ing", "ins", "Details not available"]
    kinds = [one(spark, text.feedback_kind(F.col("f")), f=f)
             for f in ("Liked", "Disliked", "too salty", None)]
    assert kinds == ["liked", "disliked", "detailed", None]


def test_json_round_trip(spark):
    assert one(spark, text.json_to_list(text.list_to_json(F.col("l"))), l=["a", 'b"c']) == [
        "a", 'b"c']


def test_summary(spark):
    summary = text.adjustment_summary(F.col("q"), F.col("a"), F.col("e"))
    assert one(spark, summary, q="soup", a=[], e=[]) == "Adjusted query: soup\n\n"
    assert one(spark, summary, q="soup", a=["x"], e=["nuts", "milk"]) == (
        "Adjusted query: soup\n\nAdjustments made:\n- x\n\nExcluded ingredients:\n- nuts\n- milk")


def test_two_decimals_round_half_even(spark):
    shown = spark.createDataFrame([(0.125,), (0.375,), (1.0,)], "v double").select(
        text.two_decimals(F.col("v")).alias("x"))
    assert [r.x for r in shown.collect()] == ["0.12", "0.38", "1.00"]
