"""Texts to chunks: by article, by windows of words, or both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.functions.text import HEADER, HEADER_FLAGS, chunk_id, strip

SIZE, OVERLAP = 1200, 200
STRATEGIES = ("article", "fixed", "hybrid")


def article_spans(c: Column) -> Column:
    """array<struct<article, body>>: from each article header to the next, and a preamble without label.

    Blank parts are left out; a text without header is one span; a null text has none.
    """
    parts = F.split(c, f"{HEADER_FLAGS}(?={HEADER})")
    label = lambda x: F.nullif(F.regexp_extract(x, HEADER_FLAGS + HEADER, 1), F.lit(""))
    spans = F.transform(parts, lambda x: F.struct(label(x).alias("article"), strip(x).alias("body")))
    return F.filter(spans, lambda s: s["body"] != "")


def _cut(words: list[str], size: int, overlap: int) -> list[str]:
    """Windows of whole words of at most ``size`` characters; the next window steps back over tail words."""
    # before[i]: characters of the first i words, each with one blank.
    before = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])
    bounds = [(0, 0)]
    while bounds[-1][1] < len(words):
        last = bounds[-1][1]
        first = max(bounds[-1][0] + 1, int(np.searchsorted(before, before[last] - overlap))) if last else 0
        bounds.append((first, max(first + 1, int(np.searchsorted(before, before[first] + size + 1, side="right")) - 1)))
    return [" ".join(words[a:b]) for a, b in bounds[1:]]


def word_windows(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string>: windows of whole words; a longer word is a window of its own; null or blank gives none."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_cut(t.split(), size, overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(c)


def chunk_texts(df: DataFrame, strategy: str = "hybrid", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """All columns of df but the text, with article, idx (from 0), text and n_chars of every chunk.

    ``hybrid`` keeps articles that fit as they stand and windows the others. One narrow stage: nothing is
    shuffled. Null and blank texts have no chunks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    keep = [c for c in df.columns if c not in (text_col, "article", "idx", "n_chars")]
    span_type = "array<struct<article:string,body:string>>"
    if strategy == "article":
        chunks = df.select(*keep, F.posexplode(article_spans(F.col(text_col))).alias("idx", "_span"))
        chunks = chunks.select(*keep, "idx", "_span.article", F.col("_span.body").alias("text"))
    elif strategy == "fixed":
        chunks = df.select(*keep, F.posexplode(word_windows(F.col(text_col), size, overlap)).alias("idx", "text")).withColumn("article", F.lit(None).cast("string"))
    else:
        if overlap >= size:
            raise ValueError("overlap must be smaller than size")

        @F.arrow_udf(T._parse_datatype_string(span_type))
        def fit(spans: pa.Array) -> pa.Array:
            out = []
            for row in spans.to_pylist():
                pieces = []
                for s in row or []:
                    bodies = [s["body"]] if len(s["body"]) <= size else _cut(s["body"].split(), size, overlap)
                    pieces += [{"article": s["article"], "body": b} for b in bodies]
                out.append(pieces)
            return pa.array(out, pa.list_(pa.struct([("article", pa.string()), ("body", pa.string())])))

        chunks = df.select(*keep, F.posexplode(fit(article_spans(F.col(text_col)))).alias("idx", "_span"))
        chunks = chunks.select(*keep, "idx", "_span.article", F.col("_span.body").alias("text"))
    return chunks.select(*keep, "article", "idx", "text", F.char_length("text").alias("n_chars"))


def chunk_records(df: DataFrame, strategy: str = "hybrid", **options) -> DataFrame:
    """Chunk records of texts with country, agency, norm_id, variant and year."""
    chunks = chunk_texts(df, strategy, **options).withColumn("strategy", F.lit(strategy))
    label = chunk_id(*(F.col(c) for c in ("country", "agency", "norm_id", "variant", "strategy", "idx")))
    return chunks.select(label.alias("chunk_id"), "text", "country", "agency", "norm_id", "variant", "year", "article", "strategy", "idx", "n_chars")
