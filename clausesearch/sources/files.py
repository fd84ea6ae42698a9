"""Files in and out: a folder of documents, and chunk records as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, text string, country string, agency string, norm_id string, variant string, year int, article string, "
    "strategy string, idx int, n_chars int, n_sources long"
)


def scan_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("pdf", "html")) -> DataFrame:
    """path, content, file_name of the files with one of the suffixes, in any case. The path orders documents."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes)).withColumn("file_name", name)


def write_jsonl(df: DataFrame, folder: str) -> None:
    """One object per line, nulls and non-ASCII letters kept; idx is called index in the files."""
    df.withColumnRenamed("idx", "index").write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk records of a folder; columns that are missing in the files are null."""
    return spark.read.schema(CHUNK_SCHEMA.replace("idx int", "index int")).json(folder).withColumnRenamed("index", "idx")
