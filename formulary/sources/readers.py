"""Reading corpora. Every reader gets its schema; files, and parts of one large JSON array, are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from formulary import schemas
from formulary.sources.arrays import RANGE_BYTES, array_rows


def read_pairs_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files that each hold one JSON array of {NL, FOL} objects; a file of any size is read by many tasks.

    An element that is not such an object gives a row of nulls. The files are listed and sized when this is called.
    """
    raw = array_rows(spark, path, schemas.PAIR_FILE, range_bytes)
    return raw.select(F.col("NL").alias("nl"), F.col("FOL").alias("fol"))


def read_examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One premise/conclusion example per line; blank lines are skipped, absent fields get defaults."""
    raw = spark.read.schema(schemas.EXAMPLE_FILE).json(path)
    return raw.select(
        F.coalesce("premises", F.array().cast("array<string>")).alias("premises"),
        F.coalesce("conclusion", F.lit("")).alias("conclusion"),
        "label",
    )


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Rows of one split of a table partitioned by `split`; the other folders are not listed as input."""
    return spark.read.parquet(root).filter(F.col("split") == split)


def training_languages(df: DataFrame, langs: list[str]) -> DataFrame:
    """Training rows of the given languages. Prunes folders when the table is partitioned by `lang`."""
    return df.filter(F.col("lang").isin(list(langs)))


def read_results(spark: SparkSession, path: str, lines: bool = True, folders: str | None = None) -> DataFrame:
    """Stored results of any variant, with all their spellings; harmonise_results merges those.

    One JSON object per line, or with lines=False one JSON array per file (read_array splits large ones). `folders` names the column of a
    table that is partitioned by one.
    """
    schema = T.StructType(schemas.RESULT_FILE.fields)
    if folders:
        schema = schema.add(folders, "string")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Elements of JSON arrays, one array per file, as rows of `schema`; one file is read by many tasks."""
    return array_rows(spark, path, schema, range_bytes)
