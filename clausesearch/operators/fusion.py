"""Reciprocal rank fusion and hybrid search over a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausesearch.operators.fulltext import search_lexical, top_k
from clausesearch.operators.vectors import IvfIndex, _usable, dense_topk, gated_topk

K, POOL = 60, 5


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = K, limit: int | None = None) -> DataFrame:
    """qid, id, score, rank from rankings (qid, id, rank): the sum of 1 / (k + rank).

    A repeated id of a ranking counts once, at its best place, and later places move up. No ranking at all
    is an error; empty rankings add nothing. Ties fall to the smaller id.
    """
    if not rankings:
        raise ValueError("no ranking given")
    parts = []
    for ranking in rankings:
        once = ranking.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))
        parts.append(once.select("qid", "id", place.alias("rank")))
    union = reduce(DataFrame.unionByName, parts)
    fused = union.groupBy("qid", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    return top_k(fused.withColumn("score", F.round("score", 12)), limit or 2**31 - 1)


def search_hybrid(df: DataFrame, queries: DataFrame, limit: int = 10, factor: int = POOL, k: int = K, country: str | None = None, config: str = "simple", id_col: str = "row_id", mode: str = "and", gated: bool = False, index: IvfIndex | None = None, stored: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank of queries (qid, qtext, qvec): dense and lexical pools fused; the fused score replaces theirs.

    A blank text leaves the dense pool alone; a query without a usable vector leaves the lexical one. With
    ``gated`` or an ``index``, the dense pool comes from an index where the table is large; ``stored`` are
    postings written before.
    """
    # Of one ranking alone, the best places stay the best, so no larger pool is needed.
    pool = limit if queries.where(_usable(F.col("qvec"))).isEmpty() else max(limit * factor, limit)
    dense = gated_topk(df, queries, pool, country, id_col, index=index) if gated or index else dense_topk(df, queries, pool, country, id_col)
    lexical = search_lexical(df, queries, pool, country, config, mode, id_col, stored)
    return reciprocal_rank_fusion([dense, lexical], k, limit)


def attach(hits: DataFrame, df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Hits with the columns that cite them, joined last so that no text goes through the ranking."""
    cited = df.select(F.col(id_col).alias("id"), "chunk_id", "text", "country", "agency", "norm_id", "variant", "year", "article")
    return hits.join(cited, "id").select("qid", "rank", "chunk_id", "text", "country", "agency", "norm_id", "variant", "year", "article", "score")
