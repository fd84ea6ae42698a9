"""Summaries and samples of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausesearch.operators.vectors import _usable
from clausesearch.runtime import materialize


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "norm_id").agg(F.count("*").alias("n_chunks"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_chunks"), F.count_distinct("norm_id").alias("n_norms"))


def citable(df: DataFrame) -> DataFrame:
    """Distinct (country, norm_id, article)."""
    return df.select("country", "norm_id", "article").distinct()


def longest_articles(df: DataFrame, more_than: int = 400, id_col: str = "row_id") -> DataFrame:
    """For each (country, norm_id, article) its longest chunk of more than so many characters; ties to the smaller id."""
    rows = df.where(F.col("article").isNotNull() & (F.col("n_chars") > more_than))
    place = F.row_number().over(Window.partitionBy("country", "norm_id", "article").orderBy(F.desc("n_chars"), id_col))
    return rows.withColumn("_r", place).where("_r = 1").drop("_r")


def round_robin(df: DataFrame, n: int, seed: int = 7, by: str = "country", key: str = "row_id") -> DataFrame:
    """n rows, taken in turn from each group, in an order that a hash of seed and key shuffles."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(by).orderBy(shuffled, key))
    return df.withColumn("_r", place).where(F.col("_r") <= n).orderBy("_r", by).limit(n).drop("_r")


def _pair_scores(table: pa.Table, keep: int) -> pa.Table:
    side = table.column("side").to_numpy()
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table.column("id").to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(a), 1024):
        rows = a[at : at + 1024]
        score = np.minimum(x[rows] @ x[b].T, 1.0)
        # The best of this block, ties kept.
        limit = np.partition(score, score.size - keep, axis=None)[score.size - keep] - 1e-9 if score.size > keep else -2
        r, c = np.nonzero(score >= limit)
        s = score[r, c]
        out.append((ids[rows[r]], ids[b[c]], s))
    one, two, s = (np.concatenate([o[j] for o in out]) for j in range(3))
    return pa.table({"a": pa.array(one), "b": pa.array(two), "score": pa.array(s)})


def cross_country_pairs(df: DataFrame, n: int = 10, more_than: int = 600, rows_of_block: int = 16_384, id_col: str = "row_id", vector_col: str = "embedding") -> DataFrame:
    """The n most similar pairs of articles of different countries, each pair of norms once: a, b, score.

    One chunk stands for an article (its longest). The articles of each country lie in blocks of at most about
    ``rows_of_block``; a block is compared with those of the countries after its own, each pair of blocks being
    one group, and a group passes on only its best 4 n pairs; of the best 4 n of all, the first of each pair of
    norms stays. Each article is copied once for each block of other countries, so the copies grow with the
    square of the articles over ``rows_of_block``.
    """
    rows = longest_articles(df, more_than, id_col).where(_usable(F.col(vector_col)) & F.col("country").isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), "country", "norm_id", F.col(vector_col).alias("v"))
    rows = materialize(rows, "articles")
    sizes = sorted((r.country, -(-r["count"] // rows_of_block)) for r in rows.groupBy("country").count().collect())  # one row a country
    blocks = [(c, i) for c, m in sizes for i in range(m)]
    first = {c: next(j for j, b in enumerate(blocks) if b[0] == c) for c, _ in sizes}
    after = {c: first[c] + m for c, m in sizes}
    table = df.sparkSession.createDataFrame([(c, m, first[c], list(range(after[c], len(blocks))), list(range(first[c]))) for c, m in sizes], "country string, m int, first int, later array<int>, earlier array<int>")
    placed = rows.join(F.broadcast(table), "country").withColumn("own", F.col("first") + F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    left = placed.select("id", "v", F.lit(0).alias("side"), F.col("own").alias("x"), F.explode("later").alias("y"))
    right = placed.select("id", "v", F.lit(1).alias("side"), F.explode("earlier").alias("x"), F.col("own").alias("y"))
    scored = left.unionByName(right).groupBy("x", "y").applyInArrow(lambda t: _pair_scores(t, 4 * n), "a long, b long, score double")
    best = scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "a", "b").limit(4 * n)
    names = rows.select("id", "country", "norm_id")
    one, two = (names.select(F.col("id").alias(s), F.col("country").alias(f"country_{s}"), F.col("norm_id").alias(f"norm_{s}")) for s in "ab")
    joined = best.join(one, "a").join(two, "b")
    place = F.row_number().over(Window.partitionBy("country_a", "norm_a", "country_b", "norm_b").orderBy(F.desc("score"), "a", "b"))
    first = joined.withColumn("_r", place).where("_r = 1").drop("_r")
    return first.orderBy(F.desc("score"), "a", "b").limit(n).select("a", "b", "country_a", "norm_a", "country_b", "norm_b", "score")
