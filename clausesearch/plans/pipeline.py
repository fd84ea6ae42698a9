"""Whole paths: files to chunks, and questions to fused hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausesearch.functions.extraction import extract_files
from clausesearch.functions.metadata import parse_file_name
from clausesearch.operators.chunking import STRATEGIES, chunk_records
from clausesearch.operators.dedup import dedup_chunks
from clausesearch.runtime import materialize
from clausesearch.sources.files import scan_folder


def ingest(spark: SparkSession, folder: str, strategies: tuple[str, ...] = STRATEGIES, pdf: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk records, failures) of a folder: text is extracted once and chunked by each strategy; failing files are listed."""
    named = parse_file_name(scan_folder(spark, folder).drop("content")).withColumnRenamed("error", "name_error")
    texts = materialize(extract_files(scan_folder(spark, folder), pdf), "texts")
    documents = texts.join(named, "path").withColumn("error", F.coalesce("name_error", "error"))
    good = documents.where("error IS NULL").select("path", "country", "agency", "norm_id", "variant", "year", "text")
    parts = [dedup_chunks(chunk_records(good, s), ["chunk_id"]) for s in strategies]
    return reduce(DataFrame.unionByName, parts), documents.where("error IS NOT NULL").select("path", "error")
