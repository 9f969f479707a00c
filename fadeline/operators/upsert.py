"""Upserts as pure DataFrame operators: they return rows, callers write them.

Duplicates of one key are folded by aggregates, which combine on the map side,
so a key whose copies make up a third of the data does not land in one task.
With a numeric arrival order and numeric values they are hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.schemas import LINK_KEY, OBSERVATION_KEY
from fadeline.session import staged


def _rest(df: DataFrame, *known: str) -> list[str]:
    return [c for c in df.columns if c not in known]


def first_wins(rows: DataFrame, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """One row per key: the one that arrived first.  ``order`` must be unique."""
    key = key or OBSERVATION_KEY
    values = _rest(rows, *key, order)
    return rows.groupBy(*key).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def last_wins(rows: DataFrame, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """One row per key: the one that arrived last.  ``order`` must be unique."""
    key = key or LINK_KEY
    values = _rest(rows, *key, order)
    return rows.groupBy(*key).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])


def fill_nulls(rows: DataFrame, values=("rsl", "tsl"), key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """One row per key: each value is the first one that is not null, so that
    files with one level each complete one another."""
    key = key or OBSERVATION_KEY
    seen = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return rows.groupBy(*key).agg(F.min(order).alias(order), *seen)


def new_rows(stored: DataFrame, incoming: DataFrame, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Rows to append so that stored rows win over incoming ones."""
    key = key or OBSERVATION_KEY
    return first_wins(incoming, key, order).join(stored.select(*key), key, "left_anti")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Stored rows, and incoming rows whose key is not stored yet; of incoming rows
    with one key the first to arrive (``seq``), or else the one with the smallest values."""
    key = key or LINK_KEY
    if "seq" in incoming.columns:
        folded = first_wins(incoming, key).drop("seq")
    else:
        values = _rest(incoming, *key)
        folded = incoming.groupBy(*key).agg(F.min(F.struct(*values)).alias("kept")).select(*key, *[F.col(f"kept.{v}").alias(v) for v in values])
    return stored.unionByName(folded.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def merge_last_wins(stored: DataFrame, incoming: DataFrame, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Stored rows with all values replaced by the newest incoming row of the key."""
    key = key or LINK_KEY
    before_all = F.lit(-(2**63)).cast("bigint")
    old = stored.withColumn(order, before_all)
    new = incoming.withColumn(order, F.col(order).cast("bigint"))
    return last_wins(old.unionByName(new), key, order).drop(order)


def repeated_keys(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once: empty when the key holds."""
    key = key or OBSERVATION_KEY
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def has_repeated_keys(rows: DataFrame, key: list[str] | None = None) -> bool:
    """Whether any key occurs twice.

    Only 64-bit hashes are shuffled at first; keys are compared just for the
    hashes that occur twice, if there are any.
    """
    key = key or OBSERVATION_KEY
    hashed = rows.withColumn("h", F.xxhash64(*key))
    again = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if again.isEmpty():
        return False
    return not repeated_keys(hashed.join(staged(again), "h", "left_semi"), key).isEmpty()
