"""One record per norm and normalised text, and statistics of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausesearch.functions.text import collapse


def dedup_chunks(df: DataFrame, order: list[str], key: str = "norm_id", text_col: str = "text") -> DataFrame:
    """The first record (by ``order``) of each (key, collapsed text), with n_sources, the size of its group.

    Aggregates on both sides of the shuffle, so a group of many copies is never collected; ties in
    ``order`` fall to the larger of equal rows alike. Null keys and texts form groups of their own.
    """
    columns = [c for c in df.columns if c != "n_sources"]
    # The text is shuffled once, with its row; as a key it is a hash of 128 bits and its length.
    hashed = df.select("*", collapse(F.col(text_col)).alias("_t"))
    grouped = hashed.groupBy(F.col(key).alias("_k"), F.xxhash64("_t").alias("_h1"), F.xxhash64(F.lit(1), "_t").alias("_h2"), F.length("_t").alias("_n"))
    first = grouped.agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"), F.count("*").alias("n_sources"))
    return first.select("r.*", "n_sources")


def chunk_statistics(df: DataFrame, by: str = "strategy", length: str = "length") -> DataFrame:
    """Per group: chunks, median (truncated), nearest-rank p95, greatest length, chunks with an article and their share in percent.

    p95 is the value of rank floor(0.95 n), at least 1, from exact counts per length, so no group is collected.
    """
    measured = df.select(by, F.char_length("text").alias("len"), (F.col("article").isNotNull() & (F.col("article") != "")).alias("labelled"))
    counts = measured.groupBy(by, "len").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    running = F.sum("n").over(Window.partitionBy(by).orderBy("len"))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.select(by, "len", running.alias("upto"), total.alias("total"))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("len")))
    t = F.col("total")
    middle = ranked.groupBy(by).agg(
        F.first("total").alias("n_chunks"), at(F.floor((t + 1) / 2)).alias("lo"), at(F.floor((t + 2) / 2)).alias("hi"), at(F.greatest(F.floor(t * F.lit(95) / F.lit(100)), F.lit(1))).alias("p95"), F.max("len").alias("longest")
    )
    labels = measured.groupBy(by).agg(F.count_if("labelled").alias("with_article"))
    return middle.join(labels, by).select(by, "n_chunks", F.floor((F.col("lo") + F.col("hi")) / 2).alias("median"), "p95", "longest", "with_article", F.floor(F.col("with_article") * 100 / F.col("n_chunks")).alias("percent"))
