"""Raw recipes to the processed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import embedding_text, parse_list_text, search_text
from larder.schemas import RAW_RECIPES
from larder.sources.quoted_csv import read_quoted_csv
from larder.sources.recipes import number_rows, read_raw_recipes, write_corpus


def prepare(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processed recipes, and the rows whose ingredient list does not parse.

    ``numbered`` holds ``index, title, cleaned_ingredients, instructions,
    image_name``.
    """
    parsed = numbered.withColumn("ingredients", parse_list_text(F.col("cleaned_ingredients")))
    good = parsed.where(F.col("ingredients").isNotNull())
    processed = good.select(
        F.col("index").cast("long").alias("index"), "title", "cleaned_ingredients",
        "ingredients", "instructions", "image_name",
        search_text(F.col("title"), F.col("ingredients"), F.col("instructions"))
        .alias("text_for_search"),
        embedding_text(F.col("title"), F.col("cleaned_ingredients"), F.col("instructions"))
        .alias("text_for_embedding"),
        (F.col("title").isNull() | F.col("instructions").isNull()).alias("has_gaps"))
    rejects = parsed.where(F.col("ingredients").isNull()).drop("ingredients")
    return processed, rejects.withColumn("error", F.lit("ingredient list does not parse"))


def ingest(spark: SparkSession, raw_path: str, corpus_path: str,
           multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read, number, compose and write; returns the corpus and the rejects.

    ``multiline``: quoted fields may hold line breaks.
    """
    raw = (read_quoted_csv(spark, raw_path, RAW_RECIPES) if multiline
           else number_rows(read_raw_recipes(spark, raw_path, multiline=False)))
    renamed = raw.select(
        "index", F.col("Title").alias("title"),
        F.col("Cleaned_Ingredients").alias("cleaned_ingredients"),
        F.col("Instructions").alias("instructions"), F.col("Image_Name").alias("image_name"))
    processed, rejects = prepare(renamed)
    write_corpus(processed, corpus_path)
    return spark.read.parquet(corpus_path), rejects
