"""Problem 5: texts that differ from each other by small edits.

Texts are sets of word shingles; two are similar when the Jaccard similarity of their sets reaches a
threshold. The join is exact and never compares all texts:

* Texts with the same words in the same order form one class; only its smallest row enters the join.
* Shingles are ordered by a fixed-size count sketch, rarest first (any order is correct; the sketch
  only makes it a good one). Two similar texts share at least ``l`` shingles within prefixes extended by
  ``l``. A shared rare shingle is found through a single-token key. If none is rare, ``m + 1`` shared
  frequent shingles fall into ``m`` hash classes, so two lie in one class and are found through the
  key of that two-token combination; combinations across classes are never formed.
* Keys are packed into one row per slice of texts and bucket, so the shuffle carries six bytes a key, however many
  buckets there are; where there are more than ``SPREAD`` buckets, slices are packed by ranges of buckets, and each
  range is put together and packed again, so the rows grow with the keys and not with slices times buckets. Inside a
  bucket, pairs of one key pass the length filter, the smaller text's shorter index prefix, and a
  bound on the symmetric difference from ``BITS``-bit maps of the sets. Sizes and maps do not travel with the keys:
  they are one table of the shared folder, and a bucket reads them there for its texts that share a key
  (through ``pyarrow.fs``, so the executors' Python must reach that folder).
* A second sketch of the same size counts, over one text in ``SAMPLED``, the combinations of shingles that are
  themselves frequent. A combination that so seems to be shared by more than ``hot`` texts goes into no bucket:
  all of its texts are sent once with a block each, Spark forms the pairs of blocks, and each is compared by a
  task of its own. The sample only chooses the way; on either way all texts of a combination are compared.
* What is left is compared by sets of 16-bit hashes, which never hide a shared shingle, and then
  verified on the whole texts.

Defined cases: null texts and texts with fewer than ``width`` words have no shingle and no partner;
equal texts are members of one class and link to the same partners; for ``near_pairs`` a pair of texts
with the same words equally often is a copy, not a pair, while ``near_groups`` links such texts if they are
similar; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.llm.text import M2, hash_words, mix, ngram_hashes, segment_sum, split_words
from clausesearch.runtime import materialize

SLOTS = 1 << 22
BLOCKS = 64
CLASSES = 16
SMALL, SMALL_MOST = 28, 47  # sets below 28 need the small scheme; their partners have at most 46 shingles
RARE = 20
HOT = 4096
BITS = 512  # of the map of a set
PLACES = 4_000_000  # shingles whose keys go into one bucket
SAMPLED = 16
SPREAD, TOGETHER = 1024, 2_000_000  # buckets that a slice is packed into at once; keys that are packed again at once


def _signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, sequence hash, bag hash (128 bits each) and number of shingle places of every text that has shingles."""

    def run(batches):
        for batch in batches:
            offsets, flat = split_words(batch.column(text_col))
            place = mix((np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64) + M2)
            lanes = []
            for seed in (0, 1):
                words = hash_words(flat, seed)
                lanes += [segment_sum(mix(words + place), offsets), segment_sum(mix(words), offsets)]
            n = np.diff(offsets) - width + 1
            keep = pa.array(n > 0)
            columns = [batch.column(id_col), *(pa.array(lanes[i].view(np.int64)) for i in (0, 2, 1, 3)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=schema.names)

    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("s1", "s2", "b1", "b2", "n"))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


SKETCHED = "block int, counts binary, rid long, n int, s binary, bits binary"
SKETCHED_NAMES = ["block", "counts", "rid", "n", "s", "bits"]


def _distinct(offsets, flat, width):
    """row and hash of each distinct shingle of each row, sorted."""
    grams, at = ngram_hashes(hash_words(flat), offsets, width)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def _sketch_rows(total: np.ndarray, kind=np.uint16) -> list[pa.Array]:
    """Block numbers and counts of a task's sketch, saturating at the greatest value of the kind."""
    short = np.minimum(total, np.iinfo(kind).max).astype(kind).reshape(BLOCKS, -1)
    return [pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in short], pa.binary())]


def _sketch_and_sets(width: int):
    """One pass over the texts: rows of the task's count sketch, and the set of each text as 16-bit hashes and as a map."""

    def run(batches):
        total = np.zeros(SLOTS, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, 5_000):
                batch = whole.slice(at, 5_000)
                row, grams = _distinct(*split_words(batch.column("t")), width)
                total += np.bincount((grams & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                n = np.bincount(row, minlength=batch.num_rows)
                short = (grams >> np.uint64(48)).astype(np.uint16)  # the leading bits, so they are in order too
                offsets = (np.concatenate([[0], np.cumsum(n)]) * 2).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(short.tobytes())])
                none = pa.nulls
                maps = _binaries(_bitmaps(row, grams, batch.num_rows))
                yield pa.RecordBatch.from_arrays([none(batch.num_rows, pa.int32()), none(batch.num_rows, pa.binary()), batch.column("rid"), pa.array(n.astype(np.int32)), sets, maps], names=SKETCHED_NAMES)
        yield pa.RecordBatch.from_arrays([*_sketch_rows(total), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int32()), *[pa.nulls(BLOCKS, pa.binary())] * 2], names=SKETCHED_NAMES)

    return run


def _merge_sketch(sketched: DataFrame, kind=np.uint16) -> np.ndarray:
    """Counts of all tasks (block, counts) in SLOTS slots, saturating at the greatest value of the kind; its size does not depend on the data."""
    size, greatest = SLOTS // BLOCKS, np.iinfo(kind).max

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for part in table.column("counts").to_pylist():
            total += np.frombuffer(part, kind)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([np.minimum(total, greatest).astype(kind).tobytes()], pa.binary())})

    out = np.zeros(SLOTS, kind)
    for block, counts in sketched.groupBy("block").applyInArrow(merge, "block int, counts binary").collect():
        out[block * size : (block + 1) * size] = np.frombuffer(counts, kind)
    return out


def _reach(num, den):
    """Keeps pairs whose 16-bit sets, compared with repetitions, can reach the threshold: never fewer shared than in truth."""

    def run(batches):
        for batch in (whole.slice(at, 5_000) for whole in batches for at in range(0, whole.num_rows, 5_000)):
            keys = []
            for side in "ab":
                n = batch.column(f"n_{side}").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), n)
                key = (row << 16) | np.frombuffer(b"".join(batch.column(f"s_{side}").to_pylist()), np.uint16)
                first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0)) if len(key) else key
                keys.append((key << 8) | np.minimum(np.arange(len(key)) - first, 255))
            both = np.sort(np.concatenate(keys))
            shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 24, minlength=batch.num_rows)
            union = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy() - shared
            keep = pa.array(shared * den >= union * num)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _ordered(offsets, flat, sketch, width):
    """row, hash, count and position of each distinct shingle of each row, rarest first; sizes of the sets."""
    grams, at = ngram_hashes(hash_words(flat), offsets, width)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    count = sketch[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((grams, (row << 16) | count))
    row, grams, count = row[order], grams[order], count[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams, count = row[new], grams[new], count[new].astype(np.int64)
    n = np.bincount(row, minlength=len(offsets) - 1)
    position = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    return row, grams, count, position, n


def _keys(row, grams, count, position, n, num, den):
    """key, row, index flag and most (a bound of its texts) of every single-token and combination key. The threshold is num / den."""
    overlap = -(-n * num // den)  # least overlap of a set with any partner
    inner = -(-n * 2 * num // (num + den))  # the same with a partner that is not smaller
    reach = np.where(n >= SMALL, CLASSES + 1, 2)
    left = (position - (n - overlap)[row]).astype(np.int64)  # below l: within the prefix extended by l
    index = (position - (n - inner)[row]).astype(np.int64)
    alone = (n == 1)[row]
    keys, rows, flags, most = [], [], [], []
    single = (count > 1) & ((count <= RARE) | alone) & (left < reach[row])
    keys.append(mix(grams[single] + np.uint64(1)))
    rows.append(row[single])
    flags.append(index[single] < reach[row[single]])
    most.append(count[single])
    for classes, chosen in ((CLASSES, n >= SMALL), (1, n <= SMALL_MOST)):
        l = classes + 1  # noqa: E741
        at = np.flatnonzero((count > RARE) & (left < l) & chosen[row])
        group = row[at] * classes + (grams[at] >> np.uint64(40)).astype(np.int64) % classes
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        here, d = np.arange(len(at)), 1
        while len(here):
            here = here[here + d < len(at)]
            here = here[group[here] == group[here + d]]
            one, two = at[here], at[here + d]
            keys.append(mix(mix(np.minimum(grams[one], grams[two])) + np.maximum(grams[one], grams[two]) + np.uint64(classes)))
            rows.append(row[one])
            flags.append((index[one] < l) & (index[two] < l))
            most.append(np.minimum(count[one], count[two]))
            d += 1
    return tuple(np.concatenate(x) for x in (keys, rows, flags, most))


def _bitmaps(row, grams, rows):
    bits = np.zeros((rows, BITS), np.uint8)
    bits[row, ((grams >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one length."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _fixed(maps: pa.Array) -> np.ndarray:
    """The maps of an array without nulls as rows of 64-bit numbers."""
    _, offsets, data = maps.buffers()
    start = int(np.frombuffer(offsets, np.int32)[maps.offset])
    return np.frombuffer(data, np.uint64, len(maps) * (BITS // 64), start).reshape(len(maps), -1)


def _maps_of(files: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and maps of the wanted texts (record numbers, ascending), from the files of the table of sets."""
    n, bits, known = np.zeros(len(wanted), np.int64), np.zeros((len(wanted), BITS // 64), np.uint64), 0
    for file in files if len(wanted) else ():
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(1 << 16, columns=["rid", "n", "bits"], use_threads=False):
                if batch.column("rid").null_count:
                    batch = batch.filter(batch.column("rid").is_valid())
                if not batch.num_rows:
                    continue
                rid, size, maps = batch.column("rid").to_numpy(), batch.column("n").to_numpy(), _fixed(batch.column("bits"))
                order = None if (rid[1:] > rid[:-1]).all() else np.argsort(rid)
                if order is not None:
                    rid, size, maps = rid[order], size[order], maps[order]
                low, high = np.searchsorted(wanted, rid[0]), np.searchsorted(wanted, rid[-1], "right")
                at = np.searchsorted(rid, wanted[low:high])
                here = np.flatnonzero(rid[at] == wanted[low:high])
                n[low + here], bits[low + here] = size[at[here]], maps[at[here]]
                known += len(here)
    if known != len(wanted):
        raise RuntimeError(f"{len(wanted) - known} texts have no map")
    return n, bits


PACKED = "bucket int, keys binary, who binary, units binary"
PACKED_NAMES = ["bucket", "keys", "who", "units"]


def _slot(keys):
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def _keyed_slices(batches, sketch, width, num, den):
    """rid, sizes, row and hash of each shingle, and the keys of slices of at most 5,000 texts."""
    for whole in batches:
        for first in range(0, whole.num_rows, 5_000):
            batch = whole.slice(first, 5_000)
            offsets, flat = split_words(batch.column("t"))
            row, grams, count, position, n = _ordered(offsets, flat, sketch, width)
            yield batch.column("rid").to_numpy(), n, row, grams, _keys(row, grams, count, position, n, num, den)


def _frequent_keys(sent, width, num, den, hot):
    """Rows of the task's count sketch of the keys that may have more than ``hot`` texts."""

    def run(batches):
        total = np.zeros(SLOTS, np.uint32)
        for *_, (keys, _, _, most) in _keyed_slices(batches, np.frombuffer(sent.value, np.uint16), width, num, den):
            total += np.bincount(_slot(keys[most > hot]), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(_sketch_rows(total, np.uint32), names=["block", "counts"])

    return run


def _rows_of_buckets(buckets, bucket, keys, marks, unit, base):
    """Packed rows of keys: keys, marks (place in the unit, index flag), and number of first text and count of keys of each unit."""
    order = np.lexsort((unit, bucket)) if len(base) > 1 else np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.append(buckets, buckets[-1] + 1) if len(buckets) else buckets)
    keys, marks, unit = keys[order], marks[order], unit[order]
    for b, low, high in zip(buckets, cut[:-1], cut[1:], strict=True):
        own = unit[low:high]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        units = np.stack([base[own[first]], np.diff(np.append(first, len(own)))], axis=1)
        yield int(b), keys[low:high].tobytes(), marks[low:high].tobytes(), units.astype(np.int64).tobytes()


def _packed(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PACKED_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=PACKED_NAMES)


def _pack(sent, counted, width, num, den, hot, ranges, each):
    """Packed rows of the keys of a range of ``each`` buckets; keys of 64 bits where a range has several buckets."""

    def run(batches):
        frequent = np.frombuffer(counted.value, np.uint32)
        for rid, _, _, _, (keys, rows, flags, most) in _keyed_slices(batches, np.frombuffer(sent.value, np.uint16), width, num, den):
            cool = (most <= hot) | (frequent[_slot(keys)].astype(np.int64) * SAMPLED <= hot)
            keys, rows, flags = keys[cool], rows[cool], flags[cool]
            bucket = (keys % np.uint64(ranges)).astype(np.int64)
            rest = keys // np.uint64(ranges)
            first = np.flatnonzero(np.append(True, np.diff(rid) != 1))  # record numbers follow one another but for a file's edge
            unit = np.searchsorted(first, rows, "right") - 1
            marks = ((rows - first[unit]) << 1 | flags).astype(np.uint16)
            yield _packed(_rows_of_buckets(np.unique(bucket), bucket, rest.astype(np.uint32) if each == 1 else rest, marks, unit, rid[first]))

    return run


def _unpack(columns, key_type):
    """key, mark, unit and the units' first record number of packed rows (lists of binaries), put together."""
    read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in columns[c]])
    base, count = read("units", np.int64).reshape(-1, 2).T
    return read("keys", key_type), read("who", np.uint16), np.repeat(np.arange(len(base)), count), base


def _pack_again(each):
    """Packed rows of ranges of buckets, sorted by range, as packed rows of their buckets."""

    def again(bucket, held):
        columns = dict(zip(PACKED_NAMES[1:], zip(*held, strict=True), strict=True))
        key, marks, unit, base = _unpack(columns, np.uint64)
        part = (key % np.uint64(each)).astype(np.int64)
        return _packed(_rows_of_buckets(np.unique(part) + bucket * each, part + bucket * each, (key // np.uint64(each)).astype(np.uint32), marks, unit, base))

    def run(batches):
        bucket, held, size = None, [], 0
        for batch in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            row = [batch.column(c)[0].as_py() for c in PACKED_NAMES]
            if held and (row[0] != bucket or size > TOGETHER):
                yield again(bucket, held)
                held, size = [], 0
            bucket = row[0]
            held.append(row[1:])
            size += len(row[2]) // 2
        if held:
            yield again(bucket, held)

    return run


HOT_MEMBERS = "key long, blocks int, rid long, n int, flag boolean, bits binary"


def _hot_members(sent, counted, width, num, den, hot):
    """The texts of each key that the sketch of keys tells to be hot, and the number of blocks for it."""

    def run(batches):
        frequent = np.frombuffer(counted.value, np.uint32)
        for rid, n, shingled, grams, (keys, rows, flags, most) in _keyed_slices(batches, np.frombuffer(sent.value, np.uint16), width, num, den):
            at = np.flatnonzero((most > hot) & (frequent[_slot(keys)].astype(np.int64) * SAMPLED > hot))
            keys, rows, flags = keys[at], rows[at], flags[at]
            blocks = -(-frequent[_slot(keys)].astype(np.int64) * SAMPLED // max(1, hot // 2))
            bits = _binaries(_bitmaps(shingled, grams, len(rid))[rows] if len(rows) else np.zeros((0, BITS // 8), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(blocks.astype(np.int32)), pa.array(rid[rows]), pa.array(n[rows].astype(np.int32)), pa.array(flags), bits], names=["key", "blocks", "rid", "n", "flag", "bits"])

    return run


def _near(left, right, n, bits, num, den):
    """Which pairs can reach the threshold, by size and by the bound on the symmetric difference."""
    ok = n[left] * den >= n[right] * num
    left, right = left[ok], right[ok]
    apart = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64)
    ok = apart * (num + den) <= (den - num) * (n[left] + n[right])
    return left[ok], right[ok]


def _groups(key, who, n, rid, flag, bits, num, den):
    """Candidate pairs (record numbers) of records that share a key; records are sorted by key, then size."""
    here, d, found = np.arange(len(key)), 1, []
    while len(here):
        here = here[here + d < len(key)]
        here = here[(key[here] == key[here + d]) & (n[who[here]] * den >= n[who[here + d]] * num)]
        first = here[flag[here]]
        for at in range(0, len(first), 1 << 17):
            part = first[at : at + (1 << 17)]
            x, y = _near(who[part], who[part + d], n, bits, num, den)
            found.append(np.stack([np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y])], axis=1))
        if len(found) > 200:
            found = [np.unique(np.concatenate(found), axis=0)]
        d += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _match(num, den, files):
    """Candidate pairs of the texts of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        key, marks, unit, base = _unpack({c: table.column(c).to_pylist() for c in PACKED_NAMES[1:]}, np.uint32)
        order = np.argsort(key, kind="stable")
        key, flag = key[order], (marks[order] & 1).astype(bool)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        some = np.diff(np.append(first, len(key))) > 1
        some &= np.logical_or.reduceat(flag, first) if len(first) else some
        some = np.repeat(some, np.diff(np.append(first, len(key))))
        order = order[some]
        key, flag = key[some], flag[some]
        rid, who = np.unique(base[unit[order]] + (marks[order] >> 1), return_inverse=True)
        n, bits = _maps_of(files, rid)
        order = np.lexsort((rid[who], n[who], key))
        pairs = _groups(key[order], who[order], n, rid, flag[order], bits, num, den)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _match_blocks(num, den):
    """Candidate pairs of one pair of blocks (x, y) of a hot key's texts."""

    def run(unit: tuple, table: pa.Table) -> pa.Table:
        within = unit[1].as_py() == unit[2].as_py()
        rid, side = table.column("rid").to_numpy(), table.column("side").to_numpy()
        n, flag = table.column("n").to_numpy().astype(np.int64), table.column("flag").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        found, right = [np.zeros((0, 2), np.int64)], np.flatnonzero(side == (0 if within else 1))
        for i in np.flatnonzero(side == 0):
            other = right[right > i] if within else right
            smaller = (n[i] < n[other]) | ((n[i] == n[other]) & (rid[i] < rid[other]))
            other = other[np.where(smaller, flag[i], flag[other])]
            x, y = np.full(len(other), i), other
            low = np.where(n[x] <= n[y], x, y)
            x, y = _near(low, x + y - low, n, bits, num, den)
            found.append(np.stack([np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _hot_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of the texts of hot keys: each text goes to the pairs of its block with every other one."""
    own = members.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = each.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rid", "n", "flag", "bits")
    return units.groupBy("key", "x", "y").applyInArrow(_match_blocks(num, den), "a long, b long")


def _verify(width, num, den, schema):
    def run(batches):
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            sets = []
            for side in "ab":
                sets.append(_distinct(*split_words(batch.column(f"t_{side}")), width))
            (ra, ga), (rb, gb) = sets
            row, grams = np.concatenate([ra, rb]), np.concatenate([ga, gb])
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            twice = np.flatnonzero((row[1:] == row[:-1]) & (grams[1:] == grams[:-1]))
            shared = np.bincount(row[twice], minlength=batch.num_rows)
            union = np.bincount(ra, minlength=batch.num_rows) + np.bincount(rb, minlength=batch.num_rows) - shared
            keep = pa.array((shared * den >= union * num) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column("rep_a").filter(keep), batch.column("rep_b").filter(keep), pa.array(shared / np.maximum(union, 1)).filter(keep)], names=schema.names)

    return run


def near_classes(df: DataFrame, id_col: str = "row_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (4, 5), hot: int = HOT, reordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): similar pairs (rep_a, rep_b, similarity) of class representatives, and (rep, id) of all rows with shingles.

    Without ``reordered``, no pairs of texts with the same words equally often.
    ``threshold`` is a fraction (numerator, denominator) from 3/5 to 1; below that, small sets would
    not share enough shingles for the two schemes of keys to cover every pair.
    """
    num, den = threshold
    if not 5 * num >= 3 * den or num > den:
        raise ValueError("the threshold must lie between 3/5 and 1")
    spark = df.sparkSession
    rows = df.select(id_col, text_col).where(F.col(text_col).isNotNull())
    signed = materialize(_signatures(rows, id_col, text_col, width), "p5-signed")
    classes = materialize(signed.groupBy("s1", "s2").agg(F.min(id_col).alias("rep"), F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("n").alias("n")), "p5-classes")
    members = signed.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("rep", id_col)
    reps = classes.select("rep", "b1", "b2").join(rows.select(F.col(id_col).alias("rep"), F.col(text_col).alias("t")), "rep")
    texts = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "p5-texts")
    places = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(8, places // 300_000), places // PLACES)
    sketched = materialize(texts.select("rid", "t").mapInArrow(_sketch_and_sets(width), SKETCHED), "p5-sketched")
    sent = spark.sparkContext.broadcast(_merge_sketch(sketched.where("block IS NOT NULL").select("block", "counts")).tobytes())

    keyed = texts.select("rid", "t")
    sampled = keyed.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0)
    frequent = _merge_sketch(sampled.mapInArrow(_frequent_keys(sent, width, num, den, hot), "block int, counts binary"), np.uint32)
    counted = spark.sparkContext.broadcast(frequent.tobytes())
    each = -(-buckets // SPREAD)
    packed = keyed.mapInArrow(_pack(sent, counted, width, num, den, hot, -(-buckets // each), each), PACKED)
    if each > 1:
        packed = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pack_again(each), PACKED)
    candidates = packed.groupBy("bucket").applyInArrow(_match(num, den, sketched.inputFiles()), "a long, b long")
    if int(frequent.max(initial=0)) * SAMPLED > hot:
        candidates = candidates.unionByName(_hot_pairs(keyed.mapInArrow(_hot_members(sent, counted, width, num, den, hot), HOT_MEMBERS), num, den))
    candidates = materialize(candidates, "p5-matched").distinct()
    sets = [sketched.where("rid IS NOT NULL").select(F.col("rid").alias(s), F.col("n").alias(f"n_{s}"), F.col("s").alias(f"s_{s}")) for s in "ab"]
    candidates = materialize(candidates.join(sets[0], "a").join(sets[1], "b").mapInArrow(_reach(num, den), "a long, b long"), "p5-candidates")
    sides = [texts.select(F.col("rid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "b1", "b2", "t"))) for s in "ab"]
    joined = candidates.join(sides[0], "a").join(sides[1], "b")
    if not reordered:
        joined = joined.where("NOT (b1_a = b1_b AND b2_a = b2_b)")
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("rep_a", id_type), T.StructField("rep_b", id_type), T.StructField("similarity", T.DoubleType())])
    pairs = joined.select("rep_a", "rep_b", "t_a", "t_b").mapInArrow(_verify(width, num, den, schema), schema)
    return materialize(pairs, "p5-pairs"), members


def near_pairs(df: DataFrame, id_col: str = "row_id", **options) -> DataFrame:
    """(a, b), a < b: all similar pairs of rows that differ in their words, copies expanded."""
    pairs, members = near_classes(df, id_col, reordered=False, **options)
    one, two = (members.select(F.col("rep").alias(f"rep_{s}"), F.col(id_col).alias(s)) for s in ("x", "y"))
    out = pairs.join(one, F.col("rep_a") == F.col("rep_x")).join(two, F.col("rep_b") == F.col("rep_y"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Alternates large-star and small-star steps, each a shuffle of the links; the number of rounds
    grows with the logarithm of the largest component. Links that have not settled after ``rounds`` are an error.
    """
    links = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    links = materialize(links, "links")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    before = mark(links)
    for _ in range(rounds):
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.where("low < high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(down, "high").select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        links = materialize(small.where("low < high").distinct(), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = links.groupBy("high").agg(F.min("low").alias("root")).select(F.col("high").alias("node"), "root")
    return roots.unionByName(links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))


def near_groups(df: DataFrame, id_col: str = "row_id", text_col: str = "text", **options) -> DataFrame:
    """id, group (the smallest id of its group) and n_links (similar classes of its own) of every row."""
    pairs, members = near_classes(df, id_col, text_col, **options)
    roots = components(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    known = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    known = known.select(F.col(id_col), F.coalesce("root", "rep").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return df.select(id_col).join(known, id_col, "left").select(id_col, F.coalesce("group", F.col(id_col)).alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
