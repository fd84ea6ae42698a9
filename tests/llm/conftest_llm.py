import random
import re
from collections import Counter

import pytest

CHUNKS = (
    "row_id long, chunk_id string, text string, country string, agency string, norm_id string, variant string, year int, article string, strategy string, idx int, n_chars int, n_sources int, "
    "loaded_at timestamp, embedding array<float>"
)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, country string, norm_id string, title string, fetched_at timestamp"
GOLDEN = "pair_id long, id string, question string, kind string, answerable boolean, expected_answer string, citations array<struct<country:string,norm_id:string,article:string>>, status string, notes string, created_at timestamp"
#: Names that the operators use inside; a table may have them as columns of its own.
CLASHING = ["id", "a", "b", "rep", "member", "key", "host", "h", "h1", "h2", "t", "n", "s", "v", "word", "words", "ids", "block", "blocks", "pos", "line", "line_no", "m", "source_", "cluster", "cell", "rid", "unit", "place", "defect", "piece", "q", "low"]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(text):
    return tuple(sorted(Counter(words(text)).items()))


@pytest.fixture
def make(spark):
    """A table from dictionaries; missing columns are null."""

    def build(schema, rows, extra=False):
        empty = spark.createDataFrame([], schema)
        df = spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))
        return df

    return build


@pytest.fixture
def sentence():
    rng = random.Random(5)
    stock = [f"palabra{i}" for i in range(400)]
    return lambda n: " ".join(rng.choice(stock) for _ in range(n))
