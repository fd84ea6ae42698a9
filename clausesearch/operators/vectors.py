"""Exact and partitioned search by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausesearch.operators.fulltext import near_best, top_k
from clausesearch.runtime import materialize

ANN_ROWS = 50_000  # below this many rows the exact scan is used
QUERY_BLOCK, ROW_BLOCK = 131_072, 65_536  # rows are sent once for each block of queries, so those are large


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; null for null, empty or all-zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.least(dot(a, b) / norm, F.lit(1.0)))


def search_dense(df: DataFrame, vector: list[float], k: int = 10, country: str | None = None, id_col: str = "row_id", vector_col: str = "embedding") -> DataFrame:
    """id, score of the k rows nearest to one vector; rows without a usable vector come last, with null."""
    rows = df if country is None else df.where(F.col("country") == country)
    rows = rows.where(F.col(vector_col).isNotNull())
    query = F.array(*(F.lit(float(x)) for x in vector))
    scored = rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), "id").limit(k)


def _usable(c: Column) -> Column:
    return c.isNotNull() & F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))


def _best(table: pa.Table, k: int) -> pa.Table:
    """Top k of each query against the rows of one block, in double precision; scores are rounded to nine decimals, so that ties are ties."""
    held = table.column("qid").is_null().to_numpy()
    x = table.column("v").combine_chunks()
    x = x.flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64) if table.num_rows else np.zeros((0, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, qids = table.column("id").to_numpy(zero_copy_only=False)[held].astype(np.int64), table.column("qid").drop_null().to_numpy()
    rows, queries = x[held], x[~held]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        score = np.minimum(queries[at : at + 256] @ rows.T, 1.0)
        for qid, own in zip(qids[at : at + 256], score, strict=True):
            # Every row that can tie with the k-th best, however many there are.
            part = near_best(own, k, 2e-9)
            part = part[np.lexsort((ids[part], -np.round(own[part], 9)))[:k]]
            out.append((np.full(len(part), qid), ids[part], own[part]))
    q, i, s = (np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))
    return pa.table({"qid": pa.array(q.astype(np.int64)), "id": pa.array(i.astype(np.int64)), "score": pa.array(np.round(s.astype(np.float64), 9))})


def dense_topk(df: DataFrame, queries: DataFrame, k: int = 10, country: str | None = None, id_col: str = "row_id", vector_col: str = "embedding") -> DataFrame:
    """qid, id, score, rank: the k nearest rows of every query (qid, qvec), exactly, block against block.

    Blocks of queries and of rows are of fixed size; each pair of blocks is one group of a shuffle that
    sends every block once to each block of the other side. Rows and queries without a usable vector
    take no part; without any such query no row is moved.
    """
    rows = df if country is None else df.where(F.col("country") == country)
    rows = rows.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(_usable(F.col("qvec"))).select(F.col("qid").cast("long").alias("qid"), F.col("qvec").alias("v"))
    m = asked.agg(F.count("*")).first()[0]
    if not m:
        return df.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    n = rows.agg(F.count("*")).first()[0]
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK), min(8, n // 4096)), max(1, -(-m // QUERY_BLOCK))
    held = rows.select("id", F.lit(None).cast("long").alias("qid"), "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"))
    asking = asked.select(F.lit(None).cast("long").alias("id"), "qid", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).alias("qb"))
    found = held.unionByName(asking).groupBy("rb", "qb").applyInArrow(lambda t: _best(t, k), "qid long, id long, score double")
    return top_k(found, k)


def ann_plan(n_rows: int) -> dict:
    """Whether to build an index, and with how many lists: at least 50,000 rows, one list per 1,000."""
    return {"build": n_rows >= ANN_ROWS, "lists": max(1, n_rows // 1000)}


class IvfIndex:
    """Inverted lists around k-means centres; always built from scratch, never updated.

    Fitted on about ``sample`` vectors, chosen by a hash of their id; every vector is in a list. A list of more
    than ``ROW_BLOCK`` vectors is searched in blocks.
    """

    def __init__(self, df: DataFrame, lists: int | None = None, id_col: str = "row_id", vector_col: str = "embedding", sample: int = 50_000, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.id_col, self.vector_col = id_col, vector_col
        unit = df.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        unit = unit.withColumn("features", array_to_vector(F.transform("v", lambda x: x.cast("double"))))
        n = unit.count()
        self.lists = lists or ann_plan(n)["lists"]
        fitted = unit.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0)
        self.model = KMeans(k=max(2, self.lists), seed=seed, distanceMeasure="cosine", maxIter=10, predictionCol="cell").fit(fitted)
        placed = self.model.transform(unit).select("id", "v", "cell")
        self.table = materialize(placed, "ivf")
        sizes = self.table.groupBy("cell").count()
        self.blocks = materialize(sizes.select("cell", F.ceil(F.col("count") / ROW_BLOCK).cast("int").alias("blocks")), "ivf-blocks")
        self.centres = np.array(self.model.clusterCenters())

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """qid, id, score, rank: the k nearest rows of each query (qid, qvec) in its ``probes`` nearest lists.

        By default the square root of the number of lists is probed. ``only`` (id) restricts the rows before they are ranked.
        """
        centres = self.centres / np.linalg.norm(self.centres, axis=1, keepdims=True)
        count = min(probes or int(np.ceil(np.sqrt(len(centres)))), len(centres))

        def route(batches):
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ centres.T), axis=1)[:, :count].astype(np.int32) if len(x) else np.zeros((0, count), np.int32)
                where = pa.array(np.repeat(np.arange(batch.num_rows), count))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(where), batch.column("v").take(where), pa.array(near.ravel())], names=["qid", "v", "cell"])

        asked = queries.where(_usable(F.col("qvec"))).select(F.col("qid").cast("long").alias("qid"), F.col("qvec").alias("v"))
        asked = asked.mapInArrow(route, "qid long, v array<float>, cell int").join(self.blocks, "cell")
        asked = asked.select(F.lit(None).cast("long").alias("id"), "qid", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        rows = self.table if only is None else self.table.join(only.select("id"), "id", "left_semi")
        held = rows.join(self.blocks, "cell").select("id", F.lit(None).cast("long").alias("qid"), "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        found = held.unionByName(asked).groupBy("cell", "block").applyInArrow(lambda t: _best(t, k), "qid long, id long, score double")
        return top_k(found, k)


def gated_topk(df: DataFrame, queries: DataFrame, k: int = 10, country: str | None = None, id_col: str = "row_id", vector_col: str = "embedding", index: IvfIndex | None = None, least_rows: int = ANN_ROWS) -> DataFrame:
    """qid, id, score, rank of the k nearest rows: by an index from ``least_rows`` rows on, by the exact scan below.

    A given index is used as it is; else one is built. The country filter comes before ranking on both ways.
    """
    if index is None and not df.count() >= least_rows:
        return dense_topk(df, queries, k, country, id_col, vector_col)
    index = index or IvfIndex(df, id_col=id_col, vector_col=vector_col)
    only = None if country is None else df.where(F.col("country") == country).select(F.col(id_col).cast("long").alias("id"))
    return index.search(queries, k, only=only)
