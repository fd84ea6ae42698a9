"""A table of chunks in a shared folder: immutable files by part, upsert by chunk_id, derived columns."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausesearch.functions.text import words
from clausesearch.operators.fulltext import postings
from clausesearch.runtime import materialize

KEY, PART, ROWS_OF_PART = "chunk_id", "_part", 200_000


def last_per_key(df: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """The last row of each key by ``order``; aggregated before the shuffle. Null keys are one key."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def merge(existing: DataFrame, new: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """Rows of ``existing`` with those of ``new`` put in place of equal keys; within ``new`` the last row wins."""
    fresh = last_per_key(new, order, key)
    return existing.join(fresh.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(fresh, allowMissingColumns=True)


def pending(df: DataFrame, existing: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key the table lacks."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


class ChunkStore:
    """Rows lie in parts by the hash of their key; an upsert writes anew only the parts that it touches.

    The first upsert fixes the number of parts: ``parts``, or one for every ``ROWS_OF_PART`` of its rows.

    A numbered state file names the folder of every part and the derived columns. It is made only where it
    does not exist yet, after all data is written: readers never see half a write, and of two writers that
    start from one state the second gets an error.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 32):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _state(self) -> dict:
        found = self._fs.globStatus(self._path("state-*.json"))
        if not found:
            return {"number": 0, "parts": self.parts, "folders": {}, "derived": {"tokens": None}}
        last = max(f.getPath().getName() for f in found)
        return json.loads(self.spark.read.text(f"{self.folder}/{last}", wholetext=True).first().value)

    def _move(self, state: dict) -> None:
        number = state["number"] + 1
        out = self._fs.create(self._path(f"state-{number:09d}.json"), False)  # an error if another writer was first
        try:
            out.write(bytearray(json.dumps(state | {"number": number}), "utf-8"))
        finally:
            out.close()

    def exists(self) -> bool:
        return bool(self._state()["folders"])

    def _derive(self, df: DataFrame, derived: dict[str, str | None]) -> DataFrame:
        """The table with its derived columns, computed where the files lack them or hold none."""
        for name, expression in derived.items():
            made = words(F.col("text")) if expression is None else F.expr(expression)
            df = df.withColumn(name, F.coalesce(F.col(name), made) if name in df.columns else made)
        return df

    def _read(self, state: dict, parts: list[str]) -> DataFrame:
        by_folder: dict[str, list[str]] = {}
        for p in parts:
            by_folder.setdefault(state["folders"][p], []).append(p)
        tables = [self.spark.read.option("basePath", f"{self.folder}/{v}").parquet(*(f"{self.folder}/{v}/{PART}={p}" for p in ps)).drop(PART) for v, ps in by_folder.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    def read(self) -> DataFrame:
        """The current table; derived columns are computed where older files lack them."""
        state = self._state()
        return self._derive(self._read(state, list(state["folders"])), state["derived"])

    def keys(self) -> DataFrame:
        state = self._state()
        return self._read(state, list(state["folders"])).select(KEY)

    def add_derived(self, name: str, expression: str) -> None:
        """A further column, given by an SQL expression over the others; no file is written anew, new files hold it."""
        state = self._state()
        self._move(state | {"derived": state["derived"] | {name: expression}})

    def _part(self, parts: int):
        return F.pmod(F.xxhash64(KEY), F.lit(parts)).cast("int")

    def upsert(self, df: DataFrame, order: list[str], embeddings: DataFrame | None = None) -> int:
        """Inserts or replaces by chunk_id; returns the rows given. New columns evolve the table.

        With ``embeddings`` (chunk_id, embedding), a row without its vector raises ValueError.
        """
        if embeddings is not None:
            df = df.drop("embedding").join(embeddings, KEY, "left")
        state = self._state()
        given = materialize(df.drop(*state["derived"]), "upsert")
        if embeddings is not None and not given.where(F.col("embedding").isNull()).isEmpty():
            raise ValueError("chunks and embeddings do not match")
        n = given.count()
        if not n:
            return 0
        if not state["folders"]:
            state["parts"] = max(state["parts"], n // ROWS_OF_PART)
        touched = [str(r[0]) for r in given.select(self._part(state["parts"])).distinct().collect()]  # at most ``parts``
        old = [p for p in touched if p in state["folders"]]
        rows = merge(self._read(state, old).drop(*state["derived"]), given, order) if old else last_per_key(given, order)
        version = f"v-{uuid.uuid4().hex}"
        self._derive(rows, state["derived"]).withColumn(PART, self._part(state["parts"])).repartition(PART).write.partitionBy(PART).parquet(f"{self.folder}/{version}")
        self._move(state | {"folders": state["folders"] | dict.fromkeys(touched, version)})
        return n

    def pending(self, df: DataFrame) -> DataFrame:
        return pending(df, self.keys()) if self.exists() else df

    def write_postings(self, config: str = "simple", id_col: str = KEY) -> DataFrame:
        """The inverted index as a table sorted by lexeme, so a search (``stored=``) reads few row groups."""
        path = f"{self.folder}/postings-{config}-{uuid.uuid4().hex}"
        listed = postings(self.read(), id_col, config=config)
        listed.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.parquet(path)
        return self.spark.read.parquet(path)
