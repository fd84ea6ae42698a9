"""Session, shared folder and table access used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "clausesearch", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings this library expects; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and all tasks run on this machine (tests, a laptop), a new temporary
    folder is made and set as the session's checkpoint folder; on a cluster that is an error, as each
    executor would write to a folder of its own.
    """
    jsc = spark.sparkContext._jsc.sc()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and jsc.getCheckpointDir().isDefined():
        where = jsc.getCheckpointDir().get()
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="clausesearch-")
        spark.sparkContext.setCheckpointDir(where)
        where = jsc.getCheckpointDir().get()
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and several consumers read the
    table instead of each running the plan again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
