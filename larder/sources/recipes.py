"""Recipe tables: raw export, processed corpus, search table, prompts, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.schemas import PROMPTS, RAW_RECIPES, SEARCH_TABLE, VECTORS
from larder.session import materialise


def read_raw_recipes(spark: SparkSession, path: str, schema: T.StructType = RAW_RECIPES,
                     multiline: bool = True) -> DataFrame:
    """The raw export; a missing path fails.

    Quoted line breaks need ``multiline``, which keeps a file in one task;
    ``read_quoted_csv`` reads them in splits.
    """
    return (spark.read.schema(schema)
            .option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("enforceSchema", False)
            .csv(path))


def number_rows(scan: DataFrame, name: str = "index") -> DataFrame:
    """Number the rows of a file scan from 0 in file order.

    Every input split counts its own rows; one small table of split offsets
    then turns the position inside a split into the running number, so no task
    sees more than its split.
    """
    staged = materialise(
        scan.select("*", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_at")), "numbered")
    splits = staged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        splits.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"),
        "offsets")
    numbered = staged.join(offsets, ["_file", "_block"]).withColumn(
        name, F.col("_offset") + F.col("_at") - F.col("_first"))
    return numbered.drop("_file", "_block", "_at", "_first", "_offset")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_corpus(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace the processed corpus; ``kind`` is ``parquet`` or ``csv``."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        text = df.select(*[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema])
        text.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), *SEARCH_TABLE.fieldNames())


def create_search_table(corpus: DataFrame, name: str) -> DataFrame:
    """(Re)create the typed search table from its projection of the corpus.

    A null in any column fails the write.
    """
    required = [F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null in {f.name}")))
                 .otherwise(F.col(f.name).cast(f.dataType)).alias(f.name)
                for f in SEARCH_TABLE]
    require(corpus, *SEARCH_TABLE.fieldNames()).select(*required).write.mode(
        "overwrite").format("parquet").saveAsTable(name)
    return corpus.sparkSession.table(name)


def write_prompts(prompts: DataFrame, path: str) -> None:
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PROMPTS]
    prompts.select(*cast).write.mode("overwrite").parquet(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), *PROMPTS.fieldNames())


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(*VECTORS.fieldNames()).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), *VECTORS.fieldNames())


def write_metrics(metrics: DataFrame, path: str, kind: str = "parquet") -> None:
    metrics.write.mode("overwrite").format(kind).option("header", True).save(path)


def image_listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the image files below ``path``; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path")
