"""Problem 7: records that differ only in spacing, case, punctuation or field order.

Every (field name, word) pair of a record is hashed and the hashes are added up modulo 2**64 in
two independent lanes: a commutative multiset hash, so neither order nor formatting matters and
nothing is sorted. Rows are grouped by key and fingerprint with map-side aggregation (a group of
copies that holds a third of all rows is one counter per task), then each member is compared with
the representative word for word; the rare row that fails is grouped again by its exact words.

Defined cases: a null or wordless text has the empty multiset, so such rows of one key are copies
of each other; a null key belongs to no set; repeated row ids stay as they are; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausesearch.llm.text import hash_words, mix, segment_sum, split_words
from clausesearch.runtime import materialize


def fingerprints(df: DataFrame, id_col: str, key_cols: list[str], fields: list[str]) -> DataFrame:
    """id, keys, ``fp1``, ``fp2`` (multiset hash) and ``n_words`` of every row."""
    keep = df.select(F.col(id_col), *key_cols, *fields)
    schema = keep.select(id_col, *key_cols).schema.add("fp1", "long").add("fp2", "long").add("n_words", "integer")
    names = [id_col, *key_cols]

    def run(batches):
        for batch in batches:
            lanes = [np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)]
            count = np.zeros(batch.num_rows, np.int64)
            for tag, field in enumerate(fields):
                offsets, flat = split_words(batch.column(field))
                count += np.diff(offsets)
                for lane in range(2):
                    seed = np.uint64(2 * tag + lane + 1)
                    lanes[lane] += segment_sum(mix(hash_words(flat, lane) + seed), offsets)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(x.view(np.int64)) for x in lanes), pa.array(count.astype(np.int32))],
                names=[*names, "fp1", "fp2", "n_words"],
            )

    return keep.mapInArrow(run, schema)


def _same_words(fields: list[str]):
    pairs = [(f"m_{f}", f"r_{f}") for f in fields]

    def run(batches):
        for batch in batches:
            same = np.ones(batch.num_rows, bool)
            for left, right in pairs:
                lo, lw = split_words(batch.column(left))
                ro, rw = split_words(batch.column(right))
                size = np.diff(lo)
                same &= size == np.diff(ro)
                # The words of rows of one size, in an order of their numbers, side by side.
                codes = pa.concat_arrays([lw, rw]).dictionary_encode().indices.to_numpy()
                sides = []
                for offsets, own in ((lo, codes[: len(lw)]), (ro, codes[len(lw) :])):
                    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                    own, row = own[same[row]], row[same[row]]
                    sides.append(own[np.lexsort((own, row))])
                row = np.repeat(np.arange(batch.num_rows), size * same)
                same[row[sides[0] != sides[1]]] = False
            yield pa.RecordBatch.from_arrays([batch.column("member"), batch.column("rep"), pa.array(same)], names=["member", "rep", "same"])

    return run


def copy_members(df: DataFrame, id_col: str, key_cols: list[str], fields: list[str]) -> DataFrame:
    """(rep, member) of every row that is a copy of an earlier id; rep is the set's smallest id."""
    rows = df.dropna(subset=[*key_cols, id_col])
    prints = materialize(fingerprints(rows, id_col, key_cols, fields), "p7-prints")
    group = [*key_cols, "fp1", "fp2", "n_words"]
    sets = prints.groupBy(group).agg(F.min(id_col).alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = prints.join(sets, group).where(F.col(id_col) != F.col("rep")).select(F.col(id_col).alias("member"), "rep")
    linked = materialize(linked, "p7-linked")
    texts = rows.select(F.col(id_col).alias("_id"), *(F.col(f).alias(f"m_{f}") for f in fields))
    reps = linked.select(F.col("rep").alias("_rep")).distinct().join(
        rows.select(F.col(id_col).alias("_rep"), *(F.col(f).alias(f"r_{f}") for f in fields)), "_rep"
    )
    both = linked.join(texts, F.col("member") == F.col("_id")).drop("_id").join(reps, F.col("rep") == F.col("_rep")).drop("_rep")
    schema = linked.select("member", "rep").schema.add("same", "boolean")
    checked = materialize(both.mapInArrow(_same_words(fields), schema), "p7-checked")
    good = checked.where("same").select("rep", "member")
    # Rows whose fingerprint met by chance: grouped by their exact words instead.
    failed = checked.where("not same").select(F.col("member").alias(id_col)).distinct()
    word = lambda f: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)), " ")
    exact = [*key_cols, *(f"w_{f}" for f in fields)]
    worded = rows.join(failed, id_col).select(F.col(id_col).alias("member"), *key_cols, *(word(f).alias(f"w_{f}") for f in fields))
    again = worded.join(worded.groupBy(*exact).agg(F.min("member").alias("rep")), exact).where("rep != member").select("rep", "member")
    return good.unionByName(again)


def collapse_copies(df: DataFrame, id_col: str, key_cols: list[str], fields: list[str]) -> DataFrame:
    """One row per distinct record: keys, smallest id and number of copies."""
    members = copy_members(df, id_col, key_cols, fields)
    extra = members.groupBy("rep").agg((F.count("*") + 1).alias("n_copies"))
    firsts = df.dropna(subset=[*key_cols, id_col]).select(id_col, *key_cols)
    firsts = firsts.join(members.select(F.col("member").alias(id_col)).distinct(), id_col, "left_anti")
    return firsts.join(extra, F.col(id_col) == F.col("rep"), "left").select(
        *key_cols, id_col, F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies")
    )
