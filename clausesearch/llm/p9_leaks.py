"""Problem 9: evaluation texts that leaked into training texts.

Every task builds an FM-index for each shard of documents it reads (bounded in words, so a shard never
grows with the table) and searches all test phrases at once: a phrase is a run of ``n`` words of an item,
found by backward search through the ranks of a wavelet matrix over the Burrows-Wheeler transform; its
places come from sampled suffix positions by walking the LF mapping. Occurrences of one item are merged
into spans, and the spans of all items into those to remove. Nothing is shuffled but the found rows. The
test items, a set that does not grow with the corpus, are sent ``ITEM_CHARS`` characters at a time (about a
million words, with distinct phrases found once on the driver), and each shard is searched for them in
blocks of ``PHRASES``; one pass over the corpus serves all items of that size, a larger set takes one pass for each.

Words are compared in lower case and without diacritics. Defined cases: null, empty and short texts and
items contain nothing; equal items are each reported; repeated documents are each reported, and different
texts of one id are cut each by its own spans; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.llm.text import split_words
from clausesearch.runtime import materialize

SAMPLE, ITEM_CHARS, PHRASES = 32, 6_000_000, 100_000


def folded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words without diacritics: offsets and flat array."""
    plain = pc.replace_substring_regex(pc.utf8_normalize(pc.fill_null(texts, ""), form="NFD"), r"\pM+", "")
    return split_words(plain)


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of s (symbols below 2**bits; a suffix is less than any it is a prefix of).

    The first ranking packs as many symbols as fit into 63 bits; each further round doubles the
    compared length and sorts only positions whose rank is still shared.
    """
    n = len(s)
    width = max(1, 63 // (bits + 1))
    key = np.zeros(n, np.int64)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(width, np.int64)])
    for i in range(width):
        key = (key << (bits + 1)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = start
    length = width
    while True:
        shared = ~(fresh & np.append(fresh[1:], True))
        if not shared.any():
            return order
        at = np.flatnonzero(shared)
        suffix = order[at]
        after = suffix + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((second, start[at]))
        order[at] = suffix[again]
        group, second = start[at][again], second[again]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        fresh[at] = new
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[at]] = start[at]
        length *= 2


class FMIndex:
    """Backward search over one shard of symbols."""

    def __init__(self, s: np.ndarray, bits: int):
        self.n, self.bits = len(s), bits
        order = suffix_array(s, bits)
        # A closing mark below every symbol sorts first, so the suffixes shift by one row.
        self.order = np.concatenate([[len(s)], order])
        self.bwt = np.where(self.order > 0, s[self.order - 1], 0)
        self.end_row = int(np.flatnonzero(self.order == 0)[0])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))]) + 1
        self.sampled = self.order % SAMPLE == 0
        self.samples = self.order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        del self.order
        self.ones, self.zeros, level = [], [], self.bwt
        for b in range(bits - 1, -1, -1):  # wavelet matrix: bit planes from the highest bit down
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row of the transform."""
        low, high = np.zeros_like(row), row
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbol >> b) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        # The row before the text's first symbol holds no symbol, though it is stored as 0.
        return high - low - ((symbol == 0) & (row > self.end_row))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n + 1, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, from the nearest sampled position to the left."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            hit = todo[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            todo = todo[~done]
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
        return out


def _phrases(texts: list[str], n: int):
    """The distinct phrases of n words of all texts: (words, their numbers in text order, first place of each phrase, owners, cuts).

    The texts that hold phrase p are owners[cuts[p]:cuts[p + 1]].
    """
    offsets, flat = folded_words(pa.array(texts, pa.string()))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    at = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    if not len(at):
        return coded.dictionary, codes, at, owner, np.zeros(1, np.int64)
    _, first, which = np.unique(codes[at[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    return coded.dictionary, codes, at[first], owner[order], np.searchsorted(which.ravel()[order], np.arange(len(first) + 1))


def _search_shard(symbols, offsets, codes, first, n, bits):
    """(row, phrase, word position in the row) of every occurrence in the texts of one shard.

    Phrase p is codes[first[p] : first[p] + n], one less than the symbols.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # Words of no item (symbol 0) never match: only runs of n known words of one text are indexed.
    known = symbols > 0
    edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(symbols)))
    keep = np.flatnonzero(known[edge] & (size >= n)) if len(edge) else []
    if len(keep) == 0:
        return (np.zeros(0, np.int64),) * 3
    lengths = size[keep] + 1  # one separating symbol after each run
    ends = np.cumsum(lengths)
    source = np.repeat(edge[keep] - (ends - lengths), lengths) + np.arange(ends[-1])
    s = symbols[np.minimum(source, len(symbols) - 1)]
    s[ends - 1] = 0
    index = FMIndex(s, bits)
    found = []
    for block in range(0, len(first), PHRASES):
        low, high = index.search(codes[first[block : block + PHRASES, None] + np.arange(n)].astype(np.int64) + 1)
        counts = high - low
        which = np.repeat(np.arange(len(low)) + block, counts)
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at = source[index.locate(rows)]
        found.append((row[at], which, at - offsets[row[at]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _spans(documents: DataFrame, items: DataFrame, n: int, doc_id: str, item_id: str, text_col: str, block: int, shard_words: int) -> DataFrame:
    """doc id, hash of the text, item id, first_word and last_word of each merged span."""
    spark = documents.sparkSession
    fields = [T.StructField("doc", documents.schema[doc_id].dataType), T.StructField("t", T.LongType()), T.StructField("item", items.schema[item_id].dataType), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]
    schema = T.StructType(fields)

    def search(blocked):
        words, codes, first, owner, cuts = _phrases([t for _, t in blocked], n)
        bits = max(1, int(len(words)).bit_length())
        sent = spark.sparkContext.broadcast((words.to_pylist(), codes, first, owner, cuts, [i for i, _ in blocked]))

        def run(batches):
            listed, codes, first, owner, cuts, names = sent.value
            value_set, id_array = pa.array(listed, pa.string()), pa.array(names, pa.from_numpy_dtype(np.int64) if names and isinstance(names[0], int) else None)
            for batch in batches:
                offsets, flat = folded_words(batch.column("x"))
                symbols = pc.fill_null(pc.index_in(flat, value_set=value_set), -1).to_numpy().astype(np.int64) + 1
                begin_row = 0
                while begin_row < batch.num_rows:  # shards of bounded size
                    end_row = max(begin_row + 1, int(np.searchsorted(offsets, offsets[begin_row] + shard_words, side="right")) - 1)
                    part = offsets[begin_row : end_row + 1]
                    row, phrase, at = _search_shard(symbols[part[0] : part[-1]], part - part[0], codes, first, n, bits)
                    count = cuts[phrase + 1] - cuts[phrase]  # a phrase may belong to several items
                    pick = np.repeat(cuts[phrase] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    row, at, item = np.repeat(row, count) + begin_row, np.repeat(at, count), owner[pick]
                    order = np.lexsort((at, item, row))
                    row, at, item = row[order], at[order], item[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + n)
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
                    here = pa.array(row[begin])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc").take(here), batch.column("t").take(here), id_array.take(pa.array(item[begin])), pa.array(at[begin].astype(np.int32)), pa.array((at[end] + n - 1).astype(np.int32))],
                        names=schema.names,
                    )
                    begin_row = end_row

        texts = documents.select(F.col(doc_id).alias("doc"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("x"))
        return texts.where(F.col("x").isNotNull()).mapInArrow(run, schema)

    blocked, size, parts = [], 0, []
    for item in items.select(item_id, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        blocked.append((item[0], item[1]))
        size += len(item[1])
        if size >= block:
            parts.append(search(blocked))
            blocked, size = [], 0
    if blocked or not parts:
        parts.append(search(blocked))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block: int = ITEM_CHARS, shard_words: int = 1_000_000) -> DataFrame:
    """doc id, item id, first_word and last_word (from 0) of each merged span that an item shares with a document."""
    spans = _spans(documents, items, n, doc_id, item_id, text_col, block, shard_words)
    return spans.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "first_word", "last_word")


def contained_items(documents: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """(doc id, item id) of every item that shares n consecutive words with a document."""
    return leaked_spans(documents, items, n, doc_id, item_id, **options).select(doc_id, item_id).distinct()


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``folded_words`` begins and ends in the text; marks after its last letter belong to it."""
    plain = pc.replace_substring_regex(pc.utf8_normalize(pa.array(list(text), pa.string()), form="NFD"), r"\pM+", "").to_pylist()
    sizes = np.array([len(c) for c in plain], np.int64)
    at = np.repeat(np.arange(len(text)), sizes)
    signs = pa.array(list("".join(plain)), pa.string()).dictionary_encode()
    inside = pc.match_substring_regex(signs.dictionary, r"^[\pL\pN]$").to_numpy(zero_copy_only=False)[signs.indices.to_numpy()] if len(at) else np.zeros(0, bool)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1) - 1] + 1
    # The next character that is no mark, at or after each place.
    solid = np.append(np.flatnonzero(sizes > 0), len(text))
    return begin, solid[np.searchsorted(solid, end)]


def _cut(text: str, spans: list[dict]) -> str:
    begin, end = word_bounds(text)
    edges = [0, *(x for s in spans for x in (begin[s["first_word"]], end[s["last_word"]])), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", **options) -> DataFrame:
    """doc id and text of every document, without the words of the spans it shares with any item (overlapping spans are one)."""
    spans = _spans(documents, items, n, doc_id, item_id, text_col, options.get("block", ITEM_CHARS), options.get("shard_words", 1_000_000)).select("doc", "t", "first_word", "last_word").distinct()
    before = Window.partitionBy("doc", "t").orderBy("first_word", "last_word").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("new", (F.col("first_word") > F.coalesce(F.max("last_word").over(before), F.lit(-2)) + 1).cast("int"))
    number = F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = fresh.withColumn("k", number).groupBy("doc", "t", "k").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    cuts = materialize(merged.groupBy("doc", "t").agg(F.array_sort(F.collect_list(F.struct("first_word", "last_word"))).alias("cuts")), "p9-cuts")
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("x")).withColumn("t", F.xxhash64("x"))

    def cut(batches):
        for batch in batches:
            texts = [_cut(t, c) for t, c in zip(batch.column("x").to_pylist(), batch.column("cuts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "x"])

    schema = T.StructType([T.StructField("doc", documents.schema[doc_id].dataType), T.StructField("x", T.StringType())])
    cleaned = rows.join(cuts, ["doc", "t"]).select("doc", "x", "cuts").mapInArrow(cut, schema)
    rest = rows.join(cuts.select("doc", "t"), ["doc", "t"], "left_anti").select("doc", "x")
    return rest.unionByName(cleaned).select(F.col("doc").alias(doc_id), F.col("x").alias(text_col))
