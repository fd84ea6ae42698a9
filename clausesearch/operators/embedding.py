"""Embedding of chunks through a client, in batches, with retries and pacing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 128
CHARS_PER_TOKEN = 3.5


class RateLimited(Exception):
    """Raised by a client that asks for a pause."""


def hashing_client(dim: int = 64) -> Callable[[list[str], str], list[list[float]]]:
    """A client without a network: signed counts of hashed words, of unit length."""

    def embed(texts: list[str], kind: str) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def with_retries(call: Callable, attempts: int = 6, wait: float = 15.0, growth: float = 1.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a RateLimited it waits and tries again, other errors pass through."""
    for attempt in range(attempts):
        try:
            return call()
        except RateLimited:
            if attempt == attempts - 1:
                raise
            sleep(wait * growth**attempt)


def pause_for(tokens: float, per_minute: float) -> float:
    """Seconds that so many tokens take at a rate per minute."""
    return 60.0 * tokens / per_minute


def embed_texts(df: DataFrame, factory: Callable = hashing_client, id_col: str = "row_id", text_col: str = "text", batch: int = BATCH, tokens_per_minute: float | None = None) -> DataFrame:
    """id and embedding of every text that isn't null; a client per task, at most ``batch`` texts a call, order kept.

    With a rate, each of the tasks paces itself; give the rate per task.
    """

    def run(batches):
        client = factory()
        for whole in batches:
            texts, vectors = whole.column(text_col).to_pylist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                vectors += with_retries(lambda part=part: client(part, "document"))
                if tokens_per_minute:
                    time.sleep(pause_for(sum(map(len, part)) / CHARS_PER_TOKEN, tokens_per_minute))
            yield pa.RecordBatch.from_arrays([whole.column(id_col), pa.array(vectors, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    rows = df.select(id_col, text_col).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")


def embed_query(text: str, client: Callable | None = None) -> list[float]:
    """One vector of a question."""
    return (client or hashing_client())([text], "query")[0]


def budget_batches(tokens: Iterable[float], budget: float) -> list[int]:
    """Batch number of each record: a batch closes when the next record would exceed the budget; a larger record ships alone."""
    out, number, used, empty = [], 0, 0.0, True
    for t in tokens:
        if not empty and used + t > budget:
            number, used = number + 1, 0.0
        out.append(number)
        used, empty = used + t, False
    return out


def token_batches(df: DataFrame, tokens_per_minute: int = 10_000, id_col: str = "row_id", text_col: str = "text", segment_rows: int = 1_000) -> DataFrame:
    """id, segment, batch: greedy batches under max(rate - 500, 1000) tokens, within segments of consecutive ids.

    Segments bound what one group holds; a batch never spans two.
    """
    budget = max(tokens_per_minute - 500, 1000)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        numbers = budget_batches(table.column("tokens").to_pylist(), budget)
        return pa.table({id_col: table.column(id_col), "segment": table.column("segment"), "batch": pa.array(numbers, pa.int32())})

    tokens = F.coalesce(F.char_length(text_col), F.lit(0)) / F.lit(CHARS_PER_TOKEN)
    rows = df.select(id_col, F.floor(F.col(id_col) / segment_rows).cast("long").alias("segment"), tokens.cast("double").alias("tokens"))
    return rows.groupBy("segment").applyInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, segment long, batch int")
