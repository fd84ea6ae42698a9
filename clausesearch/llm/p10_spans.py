"""Problem 10: long spans that stand verbatim in more than one record.

Windows of ``k`` characters are hashed at every position and winnowed: of any ``length - k + 1``
consecutive windows the least hash is kept, so two texts with ``length`` characters in common share
a kept hash. The hashes go into a log-structured index of immutable runs in the shared folder, each bucketed
and sorted by hash, with a bucket for every ``BUCKET_CHARS`` characters of the first table. A new batch becomes a
run and is merge-joined with the older runs, bucket by bucket, without a shuffle. Before a batch is added to
more than ``fanout`` runs, the newest runs of like size are compacted into one. The index is reopened by its
folder, and a later batch reads its own texts and the runs alone (``new_pairs``). A hash that a task meets more
than ``HOT`` times goes into a part of the run that is not bucketed but spread over all tasks, so no hash
fills a bucket. Shared hashes are verified on the characters around them.

Texts are compared by code points as they stand. Defined cases: null texts and texts shorter than
``length`` share nothing; a span repeated inside one record only is not shared; equal texts share all
of their text; in periodic text (equal hashes at equal distances of at most ``k``) the first and last
two places of each run are compared, which loses no match, and elsewhere a place is left out only if all
of its context stands at another place of its record; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.llm.text import M1, mix
from clausesearch.runtime import materialize, shared_dir

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BUCKET_CHARS, HOT, SKETCH, PART, PAIRS_OF_TASK = 16_000_000, 2_000, 1 << 20, 512, 500_000
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k symbols."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + M1) * _powers(BASE, len(codes)))])
    return mix((sums[k:] - sums[:n]) * _powers(INVERSE, n))


def _sliding(values: np.ndarray, w: int, f, fill) -> np.ndarray:
    """f (minimum or maximum) over each window of w values, padded at the end with fill."""
    n = len(values)
    padded = np.full(-(-(n + w) // w) * w, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def winnow(texts: list[str | None], k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every kept window."""
    chosen = [i for i, t in enumerate(texts) if t is not None and len(t) >= length]
    empty = np.zeros(0, np.int64)
    if not chosen:
        return empty, empty, empty
    codes = np.frombuffer("".join(texts[i] for i in chosen).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(texts[i]) for i in chosen])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    w = length - k + 1
    hashes = window_hashes(codes, k)
    n = len(hashes)
    left = np.repeat(ends, sizes)[:n] - np.arange(n)  # characters to the end of the text
    least = _sliding(hashes, w, np.minimum, np.uint64(2**64 - 1))
    least[left < length] = 0  # that window would leave its text
    # Kept: equal to the least hash of some window that covers it, that is, to the greatest of those.
    back = _sliding(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((hashes == back) & (left >= k))
    text = np.searchsorted(ends, at, side="right")
    return np.array(chosen)[text], at - starts[text], hashes[at].view(np.int64)


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int, length: int) -> DataFrame:
    """h, id and pos of the kept windows of every text, and whether the task had met the hash's slot ``HOT`` times before."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("pos", T.IntegerType()), T.StructField("hot", T.BooleanType())])

    def run(batches):
        met = np.zeros(SKETCH, np.int64)
        for batch in batches:
            step = 500  # texts at a time, to bound the arrays
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                text, at, h = winnow(part.column(text_col).to_pylist(), k, length)
                slot = h & (SKETCH - 1)
                hot = met[slot] >= HOT
                met += np.bincount(slot, minlength=SKETCH)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(id_col).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(hot)], names=schema.names)

    rows = df.select(id_col, text_col).where(F.char_length(text_col) >= length)
    return rows.mapInArrow(run, schema)


class FingerprintIndex:
    """Sorted immutable runs of window hashes in a folder; an existing folder is opened as it was left.

    The newest complete state file names the runs, so a batch that fails half-way changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 8, fanout: int = 2):
        self.spark, self.fanout, self.buckets, self.runs = spark, fanout, buckets, []
        self.folder = (folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.state, self.tables = 0, {}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            last = max(f.getPath().getParent().getName() for f in found)
            self.state = int(last.split("-")[1])
            left = json.loads(spark.read.text(f"{self.folder}/{last}").first().value)
            self.buckets, self.runs = left["buckets"], left["runs"]

    def _save(self, runs: list[dict]) -> None:
        self.state += 1
        line = json.dumps({"buckets": self.buckets, "runs": runs})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.folder}/state-{self.state:08d}")
        self.runs = runs

    def _write(self, rows: DataFrame) -> dict:
        """A run: hot rows are spread over the tasks, all others lie in the bucket of their hash."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        spread = rows.repartition(self.buckets, F.when(F.col("hot"), F.xxhash64("h", "id")).otherwise(F.col("h")))
        spread.write.option("compression", "zstd").partitionBy("hot").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.tables[path] = name
        sizes = {r.hot: r["count"] for r in self.spark.read.parquet(path).groupBy("hot").count().collect()} if self._any(path) else {}
        kind = rows.schema["id"].dataType.simpleString()
        return {"path": path, "rows": sum(sizes.values()), "hot": sizes.get(True, 0), "id": kind}

    def _any(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hot=*")
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at))

    def _cool(self, run: dict) -> DataFrame:
        """The bucketed part of a run."""
        if run["path"] not in self.tables:
            name = self.tables[run["path"]] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, id {run['id']}, pos INT, hot BOOLEAN) USING parquet PARTITIONED BY (hot) CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{run['path']}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(self.tables[run["path"]]).where("NOT hot").select("h", "id", "pos")

    def _hot(self, run: dict) -> DataFrame:
        return self.spark.read.parquet(f"{run['path']}/hot=true").select("h", "id", "pos")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds (h, id, pos, hot) rows as a run; (h, id, pos) of both sides of every hash that the batch shares with older runs or within itself."""
        self.compact()
        new, old = self._write(batch), self.runs
        ends = lambda df: df.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        fresh = self._cool(new)
        shared = [fresh.join(ends(fresh).where("lo < hi").select("h").hint("merge"), "h", "left_semi")]
        for run in old:
            cool = self._cool(run)
            keys = cool.select("h").distinct().join(fresh.select("h").distinct().hint("merge"), "h", "left_semi")
            shared += [cool.join(keys.hint("merge"), "h", "left_semi"), fresh.join(keys.hint("merge"), "h", "left_semi")]
        # Hot hashes of any run, with all their rows: few hashes, each aggregated before it is joined.
        if any(run["hot"] for run in [*old, new]):
            hot = reduce(DataFrame.unionByName, (self._hot(run).select("h").distinct() for run in [*old, new] if run["hot"])).distinct()
            every = [self._cool(run).join(hot, "h", "left_semi").withColumn("new", F.lit(run is new)) for run in [*old, new]]
            every += [self._hot(run).withColumn("new", F.lit(run is new)) for run in [*old, new] if run["hot"]]
            places = materialize(reduce(DataFrame.unionByName, every), "p10-hot")
            keys = places.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("new").alias("new")).where("new AND lo < hi").select("h")
            shared.append(places.join(keys, "h", "left_semi").drop("new"))
        self._save([*old, new])
        return reduce(DataFrame.unionByName, shared)

    def compact(self) -> None:
        """Where there are more than ``fanout`` runs, the newest ones become one, as far back as a run has at most twice the rows of those after it."""
        if len(self.runs) <= self.fanout:
            return
        first, rows = len(self.runs) - 1, self.runs[-1]["rows"]
        while first and self.runs[first - 1]["rows"] <= 2 * rows:
            first -= 1
            rows += self.runs[first]["rows"]
        if first < len(self.runs) - 1:
            old = self.runs[first:]
            parts = [self._cool(run).withColumn("hot", F.lit(False)) for run in old] + [self._hot(run).withColumn("hot", F.lit(True)) for run in old if run["hot"]]
            self._save([*self.runs[:first], self._write(reduce(DataFrame.unionByName, parts))])
            self.close(old)

    def close(self, runs: list[dict] | None = None) -> None:
        """Takes the tables of runs (all by default) out of the session's catalogue; their files stay."""
        for run in self.runs if runs is None else runs:
            if run["path"] in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run['path'])}")


def shared_places(df: DataFrame, id_col: str, text_col: str, date: str | None, length: int, k: int | None = None, batches: int = 3, outer_only: bool = True) -> DataFrame:
    """(h, id, pos) of every kept window whose hash occurs in several records, through an index, batch by batch in order of dates.

    With ``outer_only``, only the outer places of periodic text.
    """
    k = k or length // 2
    spark = df.sparkSession
    split = date is not None and batches > 1
    moments = F.percentile_approx(F.unix_micros(date), [i / batches for i in range(1, batches)]) if split else F.lit(None)
    chars, cuts = df.select(F.sum(F.char_length(text_col)).alias("n"), moments.alias("c")).first()
    index = FingerprintIndex(spark, buckets=max(8, -(-(chars or 0) // BUCKET_CHARS)))
    if split:
        cuts = cuts or []
        number = sum((F.coalesce(F.unix_micros(date) > F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    else:
        batches, number = 1, F.lit(0)
    found = None
    for i in range(batches):
        part = materialize(index.add(fingerprints(df.where(number == i), id_col, text_col, k, length)).distinct(), "p10-shared")
        found = part if found is None else found.unionByName(part)
    index.close()
    return _outer(found.distinct(), k) if outer_only else found.distinct()


def _outer(found: DataFrame, k: int) -> DataFrame:
    """Places (h, id, pos) without the inner ones of periodic text."""
    # Periodic text: of a run of equal hashes at one distance of at most a window, the two outer places on each side stand
    # for all. At wider or unequal distances the text between may differ, so every place stays.
    order = Window.partitionBy("h", "id").orderBy("pos")
    step = F.col("pos") - F.lag("pos", 1).over(order)
    same = [F.lag("pos", 1).over(order) - F.lag("pos", 2).over(order), F.lead("pos", 1).over(order) - F.col("pos"), F.lead("pos", 2).over(order) - F.lead("pos", 1).over(order)]
    inner = (step <= k) & (same[0] == step) & (same[1] == step) & (same[2] == step)
    return found.withColumn("inner", F.coalesce(inner, F.lit(False))).where("NOT inner").drop("inner")


def _contexts(df: DataFrame, places: DataFrame, id_col: str, text_col: str, k: int, length: int) -> DataFrame:
    """h, id and the distinct surroundings of its places: the characters before and after that a match of the length can need."""
    reach = length - k
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    per = places.groupBy("id").agg(F.collect_list(F.struct("h", "pos")).alias("p"))
    each = texts.join(per, "id").select("id", "t", F.explode("p").alias("p"))
    start = F.greatest(F.col("p.pos") - reach, F.lit(0))
    return each.select("id", F.col("p.h").alias("h"), (F.col("p.pos") - start).alias("before"), F.substring("t", start + 1, F.col("p.pos") - start + k + reach).alias("c")).distinct()


def sharing_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", date: str | None = "fetched_at", length: int = 240, batches: int = 3) -> DataFrame:
    """(a, b), a < b: records with at least ``length`` consecutive characters in common."""
    k = length // 2
    df = df.where(F.char_length(text_col) >= length)
    return _pairs(df, materialize(shared_places(df, id_col, text_col, date, length, k, batches), "p10-places"), id_col, text_col, length)


def new_pairs(index: FingerprintIndex, batch: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240) -> DataFrame:
    """(a, b), a < b: pairs with a record of ``batch``, which is added to the index; ``documents`` holds the batch and all texts added before.

    Of the older texts only those that share a hash with the batch are read, around their places.
    """
    k = length // 2
    places = materialize(_outer(index.add(fingerprints(batch, id_col, text_col, k, length)).distinct(), k), "p10-places")
    pairs = _pairs(documents.where(F.char_length(text_col) >= length), places, id_col, text_col, length)
    fresh = batch.select(F.col(id_col).alias("n")).distinct()
    either = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("n")).join(fresh, "n", "left_semi")
    return either.select("a", "b").distinct()


def _most(limit: int, holds) -> int:
    """The greatest n up to the limit for which an equality of n characters holds."""
    if holds(limit):
        return limit
    low, high = 0, limit - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


def _pairs(df: DataFrame, places: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """The pairs of places with the same hash whose surroundings have ``length`` characters in common."""
    k = length // 2
    context = materialize(_contexts(df, places, id_col, text_col, k, length), "p10-context")
    # A hash with many surroundings: one side lies in parts of about PART, each compared with all of the other side by a task of its own.
    crowded = context.groupBy("h").count().where(F.col("count") > PART).select("h", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    placed = context.join(crowded, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda s, part: placed.select("h", part.alias("part"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "before", "c")))
    # The pairs to compare, not the bytes, tell how many tasks there are.
    compared = context.groupBy("h").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0
    tasks = int(min(20_000, max(1, compared // PAIRS_OF_TASK)))
    left, right = side("a", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = T.StructType([T.StructField("a", df.schema[id_col].dataType), T.StructField("b", df.schema[id_col].dataType)])

    def verify(batches):
        for batch in batches:
            same = np.zeros(batch.num_rows, bool)
            columns = (batch.column(c).to_pylist() for c in ("c_a", "c_b", "before_a", "before_b"))
            for i, (a, b, x, y) in enumerate(zip(*columns, strict=True)):
                if a == b and x == y and len(a) >= length:
                    same[i] = True
                    continue
                if a[x : x + k] != b[y : y + k]:
                    continue
                back = _most(min(x, y), lambda n, a=a, b=b, x=x, y=y: a[x - n : x] == b[y - n : y])
                after = _most(min(len(a) - x, len(b) - y) - k, lambda n, a=a, b=b, x=x + k, y=y + k: a[x : x + n] == b[y : y + n])
                same[i] = back + k + after >= length
            keep = pa.array(same)
            yield pa.RecordBatch.from_arrays([batch.column("id_a").filter(keep), batch.column("id_b").filter(keep)], names=["a", "b"])

    if tasks > 1:
        left = left.repartition(tasks, "h", "part")
    pairs = left.join(right, ["h", "part"]).where("id_a < id_b").select("id_a", "id_b", "before_a", "before_b", "c_a", "c_b")
    return pairs.mapInArrow(verify, schema).distinct()


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", date: str | None = "fetched_at", length: int = 240, batches: int = 3) -> DataFrame:
    """id, start and end of each maximal span whose every window of ``length`` characters stands in another record.

    No pairs are formed: around each shared place all windows of full length are hashed (128 bits) and
    counted over distinct records, so a passage in a third of all records costs as much as its copies.
    """
    k = length // 2
    df = df.where(F.char_length(text_col) >= length)
    places = materialize(shared_places(df, id_col, text_col, date, length, k, batches, outer_only=False), "p10-places")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    near = texts.join(places.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("p")), "id")
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("pos", T.IntegerType()), T.StructField("g1", T.LongType()), T.StructField("g2", T.LongType())])

    def run(batches):
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            rows, places, hashes = [], [], ([], [])
            for row, (text, near_to) in enumerate(zip(batch.column("t").to_pylist(), batch.column("p").to_pylist(), strict=True)):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                wanted = np.zeros(len(codes) + 2, np.int64)
                for p in near_to:
                    wanted[max(0, p - (length - k))] += 1
                    wanted[p + 1] -= 1
                at = np.flatnonzero(np.cumsum(wanted)[: max(len(codes) - length + 1, 0)] > 0)
                rows.append(np.full(len(at), row))
                places.append(at)
                for lane, c in enumerate((codes, codes ^ np.uint32(0x5A5A5A))):
                    hashes[lane].append(window_hashes(c, length)[at])
            if rows:
                join = np.concatenate
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(join(rows))), pa.array(join(places).astype(np.int32)), *(pa.array(join(h).view(np.int64)) for h in hashes)], names=schema.names)

    windows = materialize(near.mapInArrow(run, schema), "p10-windows")
    common = windows.groupBy("g1", "g2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g1", "g2")
    hit = windows.join(common, ["g1", "g2"], "left_semi")
    order = Window.partitionBy("id").orderBy("pos")
    new = (F.col("pos") > F.lag("pos").over(order) + length).cast("int")
    number = F.sum(F.coalesce(new, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = hit.withColumn("span", number).groupBy("id", "span").agg(F.min("pos").alias("start"), (F.max("pos") + length).cast("int").alias("end"))
    return spans.select(F.col("id").alias(id_col), "start", "end")


def shared_amounts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, number of characters inside shared spans, of every record."""
    amounts = shared_spans(df, id_col, text_col, **options).groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    return df.select(id_col).join(amounts, id_col, "left").select(id_col, F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
