"""Column expressions over text and lists.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A search term is a run of letters and digits.
TERM_PATTERN = r"[\p{L}\p{N}]+"
IMAGE_FOLDER = "data/Food_Images"


def terms_of(text: Column) -> Column:
    """Lower-cased search terms of a text in reading order; none for a null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_list_text(text: Column) -> Column:
    """``['a', "b's"]`` as an array; null when the text is not a list of strings.

    Python's ``\\xNN`` escapes and a trailing comma are put into JSON form
    first; quotes of either kind are read by the JSON reader itself.
    """
    plain = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    plain = F.regexp_replace(plain, r",\s*\]\s*$", "]")
    parsed = F.from_json(plain, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})
    is_list = text.rlike(r"^\s*\[") & ~F.exists(parsed, lambda item: item.isNull())
    return F.when(is_list, parsed)


def comma_text(items: Column) -> Column:
    return F.array_join(items, ", ")


def numbered_text(items: Column) -> Column:
    """``1. first`` / ``2. second`` on separate lines."""
    lines = F.transform(
        items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))
    return F.array_join(lines, "\n")


def search_text(title: Column, ingredients: Column, instructions: Column) -> Column:
    empty = F.lit("")
    return F.concat(
        F.coalesce(title, empty), F.lit(". Ingredients: "), comma_text(ingredients),
        F.lit(". Instructions: "), F.coalesce(instructions, empty))


def embedding_text(title: Column, ingredients_text: Column, instructions: Column) -> Column:
    """The three parts with blanks between; null as soon as one is null."""
    return F.concat(title, F.lit(" "), ingredients_text, F.lit(" "), instructions)


def image_path(image_name: Column, folder: str = IMAGE_FOLDER) -> Column:
    return F.concat(F.lit(f"{folder}/"), image_name, F.lit(".jpg"))


def list_to_json(items: Column) -> Column:
    return F.to_json(items)


def json_to_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def bullet_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")


def adjustment_summary(adjusted: Column, adjustments: Column, excluded: Column) -> Column:
    """Shown to the user; a section without entries is left out."""
    return F.concat(
        F.lit("Adjusted query: "), adjusted, F.lit("\n\n"),
        F.when(F.size(adjustments) > 0,
               F.concat(F.lit("Adjustments made:\n"), bullet_text(adjustments)))
         .otherwise(""),
        F.when(F.size(excluded) > 0,
               F.concat(F.lit("\n\nExcluded ingredients:\n"), bullet_text(excluded)))
         .otherwise(""))


def adjustment_digest(when: Column, original: Column, adjusted: Column, excluded: Column) -> Column:
    """One entry of the recent-adjustments page."""
    return F.concat(
        F.lit("**Timestamp:** "), when, F.lit("\n\n**Original Query:** **"), original,
        F.lit("**\n\n**Adjusted Query:** **"), adjusted,
        F.lit("**\n\n**Excluded Ingredients:** "), comma_text(excluded), F.lit("\n\n---\n\n"))


def feedback_kind(feedback: Column) -> Column:
    """liked, disliked or detailed; null stays null."""
    return (F.when(feedback == "Liked", "liked")
             .when(feedback == "Disliked", "disliked")
             .when(feedback.isNotNull(), "detailed"))


def view_label(detail: Column) -> Column:
    return F.concat(F.lit("View "), detail)


def detail_text(detail: Column, ingredients: Column, instructions: Column) -> Column:
    """The recipe column a detail view shows."""
    return (F.when(detail == "Ingredients", ingredients)
             .when(detail == "Instructions", instructions)
             .otherwise("Details not available"))


def two_decimals(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.00"))
