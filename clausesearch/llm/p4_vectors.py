"""Problem 4: the k most similar vectors of every vector, by cosine.

Unit vectors are put into cells of about ``CELL`` rows by a two-level k-means; every vector is stored in
its nearest cell and asks its ``probes`` nearest cells. Within a cell the residuals to the cell's centre
are quantised with four bits for each dimension, score-aware: the loss weighs the error
parallel to the vector more than the error across it, as that is what changes inner products. A query
scans the cell through lookup tables (two four-bit codes at a time), and the best ``rerank`` rows are
scored exactly. The answers of a query's cells are merged.

Fitted on samples (documented bounds): upper centres and codebooks on at most about ``SAMPLE`` vectors,
lower centres on about ``PER_CELL`` vectors a cell, at most ``LOWER_SAMPLE`` for each upper cell; every vector
is indexed. Centres are broadcast; at most ``MAX_CELLS`` of them exist. A cell with more than ``BLOCK`` queries
or stored vectors is scanned in blocks of both sides, each pair of blocks by a task of its own, and the
answers of the blocks are merged like those of several cells. Equal vectors form one class of which one enters the index.

Defined cases: null, all-zero and non-finite vectors take no part; vectors of each length are a collection of
their own; a row is not its own neighbour; among equal similarities smaller ids come first; fewer than k other
vectors give fewer neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.runtime import materialize

CELL, SAMPLE, PER_CELL, LOWER_SAMPLE, MAX_CELLS, BLOCK = 256, 24_000, 64, 65_536, 65_536, 16_384
ALIGNMENT = 0.2  # queries whose cosine with a vector is above this are the ones that matter


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centres of the rows of x; empty centres move to the rows farthest from theirs."""
    if len(x) == 0:
        return np.zeros((1, x.shape[1]), np.float32)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, k)]].copy()
    for _ in range(rounds):
        own, near = assign(x, centres)
        sums = np.zeros(centres.shape, np.float64)
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(centres))
        starts = np.cumsum(count) - count
        filled = count > 0
        sums[filled] = np.add.reduceat(x[order].astype(np.float64), starts[filled], axis=0)
        centres[filled] = (sums[filled] / count[filled, None]).astype(np.float32)
        gone = np.flatnonzero(~filled)
        if len(gone):
            centres[gone] = x[np.argsort(-near)[: len(gone)]]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance, but for the row's own length."""
    half = (centres * centres).sum(axis=1) / 2
    own, near = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for at in range(0, len(x), 4096):
        score = half - x[at : at + 4096] @ centres.T
        own[at : at + 4096] = score.argmin(axis=1)
        near[at : at + 4096] = score[np.arange(len(score)), own[at : at + 4096]]
    return own, near


def encode(residual: np.ndarray, unit: np.ndarray, books: np.ndarray, weight: float) -> np.ndarray:
    """Four-bit codes of each dimension: coordinate descent on the score-aware loss.

    The loss is |e|^2 + (weight - 1) (e . unit)^2 for the error e of the whole residual.
    """
    m = books.shape[0]
    codes = np.empty((len(residual), m), np.uint8)
    along = np.empty((len(residual), m), np.float32)
    rows = np.arange(len(residual))
    for sweep in range(2):
        total = along.sum(axis=1) if sweep else None
        for j in range(m):
            error = residual[:, j, None] - books[j]
            loss = error * error
            part = error * unit[:, j, None]
            if sweep:
                loss += (weight - 1) * ((total - along[:, j])[:, None] + part) ** 2
            best = loss.argmin(axis=1)
            chosen = part[rows, best]
            if sweep:
                total += chosen - along[:, j]
            along[:, j] = chosen
            codes[:, j] = best
    return codes


def codebooks(residual: np.ndarray, unit: np.ndarray, weight: float, rounds: int = 4) -> np.ndarray:
    """Sixteen levels for each dimension, alternating encoding and weighted least squares."""
    m = residual.shape[1]
    books = np.zeros((m, 16), np.float32)
    for j in range(m):
        levels = kmeans(np.ascontiguousarray(residual[:, j, None]), 16, rounds=8)
        books[j, : len(levels)] = levels[:, 0]
    for _ in range(rounds):
        codes = encode(residual, unit, books, weight)
        along = (residual - books[np.arange(m), codes]) * unit
        total = along.sum(axis=1)
        for j in range(m):
            x, v = residual[:, j].astype(np.float64), unit[:, j].astype(np.float64)
            other = total - along[:, j]
            left = np.bincount(codes[:, j], 1 + (weight - 1) * v * v, 16)
            right = np.bincount(codes[:, j], x + (weight - 1) * v * (other + x * v), 16)
            books[j] = np.where(left > 0, right / np.where(left > 0, left, 1), books[j])
    return books


def scan(data: np.ndarray, ids: np.ndarray, packed: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, books: np.ndarray, k: int, rerank: int):
    """Top k ids and exact scores of each query among the data of one cell; missing places have id -1.

    ``packed``: two codes of four bits a byte, which make one table index.
    """
    n, m = len(packed), packed.shape[1] * 2
    out_ids, out_scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2, np.float32)
    if n == 0:  # a cell near to some queries that stores no vector itself
        return out_ids, out_scores
    two = packed.astype(np.int64)
    for at in range(0, len(queries), 1024):
        q = queries[at : at + 1024]
        table = np.einsum("qm,mc->mcq", q, books)
        scale = 30_000 / max(float(np.abs(table).max(axis=1).sum(axis=0).max()), 1e-9)  # the sum fits 16 bits
        table = np.rint(table * scale).astype(np.int16)
        tables = (table[0::2, :, None, :] + table[1::2, None, :, :]).reshape(m // 2, 256, len(q))
        width = max(rerank, k + 1)
        best_ids, best = None, None
        for part in range(0, n, 8192):
            rows = two[part : part + 8192]
            score = np.zeros((len(rows), len(q)), np.int16)
            for j in range(m // 2):
                score += tables[j][rows[:, j]]
            score = score.T
            if len(rows) > width:
                chosen = np.argpartition(-score, width - 1, axis=1)[:, :width]
            else:
                chosen = np.broadcast_to(np.arange(len(rows)), score.shape)
            exact = np.einsum("qrd,qd->qr", data[part : part + 8192][chosen], q)
            found = ids[part : part + 8192][chosen]
            exact = np.where(found == query_ids[at : at + 1024, None], np.float32(-2), exact)
            if best is not None:
                found, exact = np.concatenate([best_ids, found], axis=1), np.concatenate([best, exact], axis=1)
            order = np.lexsort((found, -exact), axis=1)[:, :k]
            best_ids, best = np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)
        w = best.shape[1]
        out_ids[at : at + 1024, :w] = np.where(best > -1.5, best_ids, -1)
        out_scores[at : at + 1024, :w] = best
    return out_ids, out_scores


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows, padded with zeros to a multiple of four dimensions."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, -dim % 4))).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _fit_lower(size_of: dict[int, int], width: int):
    def run(table: pa.Table) -> pa.Table:
        top = table.column("top")[0].as_py()
        x = _matrix(table.column("v"), np.float32, width)
        centres = kmeans(x, max(1, min(size_of.get(top, 1), len(x) // 4)), rounds=6)
        return pa.table({"top": pa.array([top] * len(centres), pa.int32()), "centre": _binary(centres)})

    return run


def neighbours(df: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", k: int = 5, probes: int = 3, rerank: int = 96) -> DataFrame:
    """id, neighbour, score and place (1 to k) for every usable vector."""
    spark = df.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(v.isNotNull() & F.exists(v, lambda x: x != 0) & finite)
    lengths = [r.d for r in rows.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    found = [_neighbours_of_length(rows.where(F.size("v") == d), d, k, probes, rerank) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "id long, neighbour long, score double, place int")


def _neighbours_of_length(rows: DataFrame, dim: int, k: int, probes: int, rerank: int) -> DataFrame:
    """The neighbours of rows (id, v) whose vectors all have ``dim`` values."""
    spark = rows.sparkSession
    width = dim + -dim % 4

    # Equal vectors: one class, of which the smallest id enters the index.
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = materialize(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "id").alias("v")), "p4-classes")
    many = classes.where("n > 1").select("h1", "h2", "rep")
    members = materialize(keyed.select("id", "h1", "h2").join(many, ["h1", "h2"]).select("rep", "id"), "p4-members")
    n = classes.count()

    def to_unit(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _binary(_unit(batch.column("v"), dim))], names=["id", "v"])

    units = classes.select("rep", "v").mapInArrow(to_unit, "id long, v binary")
    step = max(1, n // SAMPLE)
    sample = units.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v").toArrow()
    x = _matrix(sample.column("v"), np.float32, width) if sample.num_rows else np.zeros((0, width), np.float32)
    cells = min(MAX_CELLS, max(1, n // CELL))
    tops = kmeans(x, max(1, min(256, int(np.sqrt(cells)), len(x) // 16)))
    own, _ = assign(x, tops)
    share = np.bincount(own, minlength=len(tops)) / max(len(x), 1)
    wanted = {i: max(1, round(cells * s)) for i, s in enumerate(share)}
    every = {i: max(1, int(-(-n * s // min(LOWER_SAMPLE, PER_CELL * wanted[i])))) for i, s in enumerate(share)}

    def to_top(batches):
        for batch in batches:
            u = _unit(batch.column("v"), dim)
            top, _ = assign(u, tops)
            ids = batch.column("rep").to_numpy()
            mod = np.array([every[i] for i in range(len(tops))])[top]
            keep = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % mod == 0
            yield pa.RecordBatch.from_arrays([pa.array(top[keep].astype(np.int32)), _binary(u[keep])], names=["top", "v"])

    lower = classes.select("rep", "v").mapInArrow(to_top, "top int, v binary").groupBy("top").applyInArrow(_fit_lower(wanted, width), "top int, centre binary").toArrow()
    parent = lower.column("top").to_numpy()
    centres = _matrix(lower.column("centre"), np.float32, width)
    for i in set(range(len(tops))) - set(parent.tolist()):  # an upper cell without sampled rows is its own lower cell
        parent, centres = np.append(parent, i), np.concatenate([centres, tops[i : i + 1]])

    def nearest_cells(u: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lower cells of each row, among those of its nearest four upper cells."""
        reach = min(4, len(tops))
        upper = np.argsort((tops * tops).sum(axis=1) / 2 - u @ tops.T, axis=1)[:, :reach]
        best = np.full((len(u), reach * count), np.inf, np.float32)
        cell = np.full((len(u), reach * count), -1, np.int32)
        for top in range(len(tops)):
            row, place = np.nonzero(upper == top)
            own = np.flatnonzero(parent == top)
            if len(row) == 0 or len(own) == 0:
                continue
            score = (centres[own] * centres[own]).sum(axis=1) / 2 - u[row] @ centres[own].T
            take = min(count, len(own))
            order = np.argsort(score, axis=1)[:, :take]
            for t in range(take):
                best[row, place * count + t] = score[np.arange(len(row)), order[:, t]]
                cell[row, place * count + t] = own[order[:, t]]
        order = np.argsort(best, axis=1)[:, :count]
        return np.take_along_axis(cell, order, 1)

    sampled_cell = nearest_cells(x, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
    weight = float((dim - 1) * ALIGNMENT**2 / (1 - ALIGNMENT**2)) if dim > 1 else 1.0
    fitted = slice(0, 12_000)
    books = codebooks(x[fitted] - centres[sampled_cell[fitted]], x[fitted], weight)

    def route(batches):
        for batch in batches:
            u = _unit(batch.column("v"), dim)
            cell = nearest_cells(u, probes)
            codes = encode(u - centres[cell[:, 0]], u, books, weight)
            codes = codes[:, 0::2] << 4 | codes[:, 1::2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * cell.shape[1]), pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _binary(u), _binary(codes), lists], names=["id", "v", "codes", "cells"])

    routed = materialize(classes.select("rep", "v").mapInArrow(route, "id long, v binary, codes binary, cells array<int>"), "p4-routed")
    asked = routed.select("id", "v", F.explode(F.array_distinct(F.filter("cells", lambda c: c >= 0))).alias("cell"))
    # Blocks of the queries and of the stored vectors of crowded cells. There are at most MAX_CELLS cells.
    pieces = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    load = routed.select(F.posexplode("cells").alias("at", "cell")).groupBy("cell").agg(F.count("*").alias("q"), F.count_if(F.col("at") == 0).alias("r"))
    load = F.broadcast(load.where((F.col("q") > BLOCK) | (F.col("r") > BLOCK)).select("cell", pieces("q").alias("qb"), F.greatest(pieces("r"), F.lit(1)).alias("rb")))
    qb, rb = (F.coalesce(c, F.lit(1)) for c in ("qb", "rb"))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stored = routed.select("id", "v", "codes", F.col("cells")[0].alias("cell")).join(load, "cell", "left").select("id", "v", "codes", "cell", own(rb).alias("y"), every(qb).alias("x"))
    asking = asked.join(load, "cell", "left").select("id", "v", F.lit(None).cast("binary").alias("codes"), "cell", own(qb).alias("x"), every(rb).alias("y"))

    def search(table: pa.Table) -> pa.Table:
        held = table.column("codes").is_valid().to_numpy()
        ids = table.column("id").to_numpy()
        vectors = _matrix(table.column("v"), np.float32, width)
        codes = _matrix(table.column("codes").drop_null(), np.uint8, width // 2)
        found, scores = scan(vectors[held], ids[held], codes, vectors[~held], ids[~held], books, k, rerank)
        q = np.repeat(ids[~held], k)
        ok = found.ravel() >= 0
        offsets = np.concatenate([[0], np.cumsum(ok.reshape(-1, k).sum(axis=1))]).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(a.ravel()[ok])) for a in (found, scores))
        return pa.table([pa.array(q[::k]), *lists], names=["id", "found", "scores"])

    answers = stored.unionByName(asking).groupBy("cell", "x", "y").applyInArrow(search, "id long, found array<long>, scores array<float>")
    zipped = F.transform(F.arrays_zip("found", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["found"].alias("i")))
    merged = answers.select("id", zipped.alias("z")).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("z")))), 1, k).alias("z"))
    links = materialize(merged.select("id", F.explode("z").alias("z")).select("id", F.col("z.i").alias("other"), (-F.col("z.s")).cast("double").alias("score")), "p4-links")

    # Classes of equal vectors are written out: every member sees the first k + 1 of its own and of the found classes.
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
    reached = links.join(first.select(F.col("rep").alias("other"), "member"), "other", "left").select("id", F.coalesce("member", "other").alias("neighbour"), "score")
    inside = first.select(F.col("rep").alias("id"), F.col("member").alias("neighbour"), F.lit(1.0).alias("score"))
    all_links = reached.unionByName(inside).join(members.select(F.col("rep").alias("id"), F.col("id").alias("row")), "id", "left")
    each = all_links.select(F.coalesce("row", "id").alias("id"), "neighbour", "score").where("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return each.withColumn("place", place).where(F.col("place") <= k)


def neighbour_pairs(df: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", k: int = 5, **options) -> DataFrame:
    """(a, b), a < b: rows of which at least one is among the k nearest of the other."""
    near = neighbours(df, id_col, vector_col, k, **options)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
