"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "fadeline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without
    the setting gets a folder of its own, because there driver and executors
    share one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="fadeline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


@contextmanager
def cache_scope():
    """Frees on leaving what ``keep`` has persisted inside.  A stream then does
    not hold the frames of past batches, and no later read of the same path is
    answered from an old cache."""
    frames: list[DataFrame] = []
    token = _kept.set(frames)
    try:
        yield
    finally:
        _kept.reset(token)
        for frame in frames:
            frame.unpersist()


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame until the cache scope ends."""
    frames = _kept.get()
    if frames is None:
        raise RuntimeError("keep() needs a cache_scope()")
    frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return frames[-1]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that no other run uses."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the work folder and read back.

    A later job may then overwrite the files that ``df`` was made from, and
    finds the rows again if executors are lost.  As a join side it has a size
    the planner knows: Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it above, instead
    of shuffling a large side for a handful of keys on a wrong estimate.
    """
    path = new_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
