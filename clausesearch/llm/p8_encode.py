"""Problem 8: encoding a corpus with a public tokenizer through a table of distinct words.

Spark splits every text into the tokenizer's words and counts them with map-side aggregation; each
distinct word is encoded once. Ids are joined back by position: the most frequent words are looked up inside
the task that holds the text, and only the remaining rare words travel, as (document, position, word) rows,
through a shuffled join. That also takes the hot keys (" de", ",") out of the shuffle. The frequent words
are those of at least some count, which a histogram of counts chooses so that at most ``hot_words`` words
of at most ``HOT_CHARS`` characters are sent: a proven bound in rows and in bytes, and no sort of the words.
Decoding joins ids to the vocabulary's pieces, whose number is fixed by the vocabulary.

Defined cases: a null or an empty text gives an empty list; strings that look like special tokens are
ordinary text; repeated ids are kept as separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.runtime import materialize

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE of this family cuts text into words.
WORD = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}++|\p{N}++|[^\t-\r\x85\p{Z}\p{L}\p{N}]++)|[\t-\r\x85\p{Z}]+(?![^\t-\r\x85\p{Z}])|[\t-\r\x85\p{Z}]+"
HOT_CHARS = 64


def split_text(text_col: str):
    """The tokenizer's words of a text, in order; they concatenate to the text."""
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), 0)


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """word, n and ids of each row of ``words`` (word, n)."""

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            encoded = tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([e.ids for e in encoded], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids array<int>")


def _lists(values: np.ndarray, sizes: np.ndarray, value_type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, value_type))


def _segments(offsets: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of all values of the chosen segments, one segment after another."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    return np.repeat(offsets[chosen] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _slices(batches, rows: int = 1_000):
    """Smaller batches, to bound what one step of a task holds."""
    return (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows))


def _hot(table: DataFrame, hot_words: int) -> pa.Table:
    """word and ids of the most frequent words: whole steps of a histogram of counts (eight to each doubling), as many as fit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    short = table.where(F.char_length("word") <= HOT_CHARS).withColumn("step", step)
    least, total = None, 0
    for row in sorted(short.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):  # at most 8 x 63 steps
        total += row.words
        if total > hot_words:
            break
        least = row.step
    return short.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "ids").toArrow().combine_chunks()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", hot_words: int = 1 << 18) -> DataFrame:
    """id and ``ids`` of every row."""
    spark = df.sparkSession
    counted = df.select(F.explode(split_text(text_col)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    table = materialize(encode_words(counted, vocabulary), "p8-words")
    hot = _hot(table, hot_words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, hot.schema) as writer:
        writer.write_table(hot)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches):
        known = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        lists = known["ids"].combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        sizes = np.append(np.diff(at), 0)  # a word that isn't known has no ids here
        at = np.append(at[:-1], 0)
        value_set = known["word"].combine_chunks()
        for whole in batches:
            words = whole.column("words")
            starts = words.offsets.to_numpy().astype(np.int64)
            distinct = words.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
            starts -= starts[0]
            # Each distinct word of a batch is looked up once.
            known_as = pc.fill_null(pc.index_in(distinct.dictionary, value_set=value_set), len(sizes) - 1).to_numpy().astype(np.int64)
            every = distinct.indices.to_numpy()
            for first in range(0, whole.num_rows, 1_000):
                batch, offsets = whole.slice(first, 1_000), starts[first : first + 1_001]
                own = every[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                index = known_as[own]
                n = sizes[index]
                before = np.concatenate([[0], np.cumsum(n)])
                ids = flat[_segments(at, sizes, index)] if len(index) else np.zeros(0, np.int32)
                rare = np.flatnonzero(index == len(sizes) - 1)
                row = np.searchsorted(offsets, rare, side="right") - 1
                place = before[rare] - before[offsets[row]]  # where its ids belong among the row's known ids
                per_row = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), _lists(ids, np.diff(before[offsets]), pa.int32()), _lists(place, per_row, pa.int32()), _lists(distinct.dictionary.take(pa.array(own[rare])), per_row, pa.string())],
                    names=[id_col, "ids", "place", "rare"],
                )

    id_type = df.schema[id_col].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", ints), T.StructField("place", ints), T.StructField("rare", T.ArrayType(T.StringType()))])
    split = df.select(id_col, split_text(text_col).alias("words"))
    partly = materialize(split.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "p8-known")

    asked = partly.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("at", "word"))
    joined = asked.join(table.select("word", F.col("ids").alias("more")), "word")
    gathered = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "more"))).alias("more"))
    both = partly.where(F.size("rare") > 0).select("row", id_col, "ids", "place").join(gathered, "row").select(id_col, "ids", "place", F.col("more.more").alias("more"))

    def merge(batches):
        for batch in _slices(batches):
            out = []
            columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ids", "place", "more"))
            for ids, place, more in zip(*columns, strict=True):
                out.append(np.insert(ids, np.repeat(place, [len(m) for m in more]), np.concatenate(list(more))))
            sizes = np.fromiter(map(len, out), np.int64, len(out))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), _lists(np.concatenate(out) if out else [], sizes, pa.int32())], names=[id_col, "ids"])

    # Texts of known words only are done; they need no join.
    return partly.where(F.size("rare") == 0).select(id_col, "ids").unionByName(both.mapInArrow(merge, T.StructType(schema.fields[:2])))


def pieces(spark: SparkSession, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """id and piece (hexadecimal bytes) of the whole vocabulary."""
    # Byte-level vocabularies write each byte as a printable character: itself, or the next unused one from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(vocabulary, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    rows = [(i, "".join(f"{byte_of[c]:02X}" for c in piece)) for piece, i in vocab.items() if all(c in byte_of for c in piece)]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(df: DataFrame, id_col: str = "doc_id", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """id and text of every row of ids; an empty list gives an empty text, and rows of one id stay apart."""
    rows = materialize(df.select(F.col(id_col).alias("key"), "ids").withColumn("row", F.monotonically_increasing_id()), "p8-ids")
    # Lists travel whole; their ids are taken apart, joined and put together again where they are.
    each = rows.repartition("row").select("key", "row", F.posexplode_outer("ids").alias("at", "id"))
    found = each.join(F.broadcast(pieces(df.sparkSession, vocabulary)), "id", "left")
    joined = found.groupBy("row").agg(F.first("key").alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("hex"))
    return joined.select(F.col("key").alias(id_col), F.coalesce(F.decode(F.unhex("hex"), "UTF-8"), F.lit("")).alias("text"))
