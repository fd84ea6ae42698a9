"""Retrieval quality: which rows hold a needle, and how often a retriever finds one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausesearch.functions.text import words

CODE = r"([A-Z]{2}-\d+)"


def containing(df: DataFrame, needle: str, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Ids of texts that contain a needle in any case; % and _ in the needle stand for any text and any character."""
    return df.where(F.col(text_col).ilike(f"%{needle}%")).select(F.col(id_col).alias("id"))


def code_truth(df: DataFrame, probes: DataFrame, id_col: str = "row_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """qid, id of every text that holds a probe's code (qid, needle): an equi join on the codes of the texts, not a scan per probe.

    With ``among`` (qid, id) only those pairs are looked at, and a code of many texts costs no more than a rare one.
    """
    listed = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(CODE), 1))
    if among is not None:
        held = df.select(F.col(id_col).alias("id"), listed.alias("codes"))
        return among.join(probes.select("qid", "needle"), "qid").join(held, "id").where(F.array_contains("codes", F.col("needle"))).select("qid", "id")
    codes = df.select(F.col(id_col).alias("id"), F.explode(listed).alias("needle"))
    return codes.join(probes.select("qid", "needle"), "needle").select("qid", "id")


def recall_at_k(truth: DataFrame, retrieved: dict[str, DataFrame]) -> DataFrame:
    """retriever, probes, hits: probes with at least one true row among those retrieved; probes without truth are left out."""
    probes = truth.select("qid").distinct()
    parts = [
        probes.join(hits.join(truth, ["qid", "id"], "left_semi").select("qid", F.lit(True).alias("hit")).distinct(), "qid", "left").select(F.lit(name).alias("retriever"), F.coalesce("hit", F.lit(False)).alias("hit"))
        for name, hits in retrieved.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("retriever").agg(F.count("*").alias("probes"), F.count_if("hit").alias("hits"))


def phrase_probes(df: DataFrame, first: int = 4, n: int = 3, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """qid and needle: the n words from the ``first`` on of every text that has them."""
    listed = df.select(F.col(id_col).alias("qid"), F.slice(words(F.col(text_col)), first, n).alias("w"))
    return listed.where(F.size("w") == n).select("qid", F.array_join("w", " ").alias("needle"))


def phrase_truth(df: DataFrame, probes: DataFrame, n: int = 3, id_col: str = "row_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """qid, id of every text that holds a probe's n words one after another: an equi join on the runs of n words.

    With ``among`` (qid, id) only those pairs are looked at, and no runs are formed.
    """
    if among is not None:
        bounded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        held = df.select(F.col(id_col).alias("id"), F.array_join(words(F.col(text_col)), " ").alias("w"))
        return among.join(probes.select("qid", "needle"), "qid").join(held, "id").where(F.contains(bounded(F.col("w")), bounded(F.col("needle")))).select("qid", "id")
    w = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where(F.size("w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    each = w.select("id", F.explode(F.array_distinct(runs)).alias("needle"))
    return each.join(probes.select("qid", "needle"), "needle").select("qid", "id")


def recall_by_kind(truth: DataFrame, retrieved: dict[str, DataFrame]) -> DataFrame:
    """kind, retriever, probes, hits: as ``recall_at_k``, for each kind of probe in truth (kind, qid, id) and retrieved (kind, qid, id)."""
    probes = truth.select("kind", "qid").distinct()
    parts = [
        probes.join(hits.join(truth, ["kind", "qid", "id"], "left_semi").select("kind", "qid", F.lit(True).alias("hit")).distinct(), ["kind", "qid"], "left").select("kind", F.lit(name).alias("retriever"), F.coalesce("hit", F.lit(False)).alias("hit"))
        for name, hits in retrieved.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "retriever").agg(F.count("*").alias("probes"), F.count_if("hit").alias("hits"))
