"""Problem 1: splitting oversized texts at natural boundaries.

The text is cut into tokens; prefix sums of their lengths give the offset of every token, and the
sorted offsets where a norm may be cut (articles, paragraphs, list items, sentences, clauses,
words) are binary searched for the last one under the limit, the strongest kind first. The next
piece starts at the first boundary within the overlap behind the cut. Where no boundary is in
reach the cut is hard, at exactly the limit.

Defined cases: a null, empty or short text gives no pieces (``all_rows=True`` gives it as one piece
unless null); a text without any boundary is cut hard; repeated rows give repeated pieces; lengths
are code points of the text itself, never a stored count.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
ARTICLE = re.compile(r"(?:^|\n)[ \t]*(?:ART[ÍI]CULO|ART\.)\s*\d+", re.IGNORECASE)
STOPS, CLAUSES = frozenset(".!?…"), frozenset(";:,)]")


def boundaries(text: str) -> list[list[int]]:
    """Offsets at which a piece may begin, by kind from strongest to weakest, each sorted."""
    tokens = TOKEN.findall(text)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).tolist()
    articles = [m.start() + (text[m.start()] == "\n") for m in ARTICLE.finditer(text)]
    lines: list[int] = []
    sentences: list[int] = []
    clauses: list[int] = []
    words: list[int] = []
    for i in range(1, len(tokens)):
        if tokens[i - 1][0].isspace():
            begin = starts[i]
            words.append(begin)
            if "\n" in tokens[i - 1]:
                lines.append(begin)
            elif i > 1 and tokens[i - 2] in STOPS:
                sentences.append(begin)
            elif i > 1 and tokens[i - 2] in CLAUSES:
                clauses.append(begin)
    return [articles, lines, sentences, clauses, words]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of at most ``limit`` characters.

    A boundary of a better kind is taken only in the second half of the limit, so that pieces are of fair
    size; where that half has none, the last boundary of any kind is taken, and without one the cut is hard.
    """
    kinds = boundaries(text)
    every = sorted({x for kind in kinds for x in kind})
    pieces, start, n = [], 0, len(text)
    while n - start > limit:
        least, most, end = start + max(limit // 2, overlap + 1), start + limit, 0
        for kind in kinds:  # the last boundary under the limit, if it leaves a piece of fair size
            i = bisect_right(kind, most) - 1
            if i >= 0 and kind[i] >= least:
                end = kind[i]
                break
        if not end:
            i = bisect_right(every, most) - 1
            end = every[i] if i >= 0 and every[i] > start + overlap else most
        pieces.append((start, end))
        i = bisect_left(every, end - overlap)
        start = every[i] if i < len(every) and every[i] < end else end - overlap
    pieces.append((start, n))
    return pieces


def split_oversized(df: DataFrame, id_col: str = "row_id", text_col: str = "text", carry: tuple[str, ...] = ("article",), limit: int = 1200, overlap: int = 200, all_rows: bool = False) -> DataFrame:
    """id, carried columns, piece_no (from 0), start and end offset, and text of each piece.

    Consecutive pieces share at most ``overlap`` characters. Only texts over the limit are split;
    that filter runs before any Python.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    rows = df.select(id_col, *carry, text_col).where(F.col(text_col).isNotNull())
    if not all_rows:
        rows = rows.where(F.char_length(text_col) > limit)
    schema = T.StructType([*rows.select(id_col, *carry).schema.fields, T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches):
        for batch in batches:
            where, number, starts, ends, parts = [], [], [], [], []
            for row, text in enumerate(batch.column(text_col).to_pylist()):
                for k, (a, b) in enumerate(cut_points(text, limit, overlap)):
                    where.append(row)
                    number.append(k)
                    starts.append(a)
                    ends.append(b)
                    parts.append(text[a:b])
            index = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(index) for c in (id_col, *carry)), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
