"""Sharding by vector bin packing: bytes, tokens and rows together.

Equal texts are a group and stay together.  Groups are packed twice by the same rule:
the largest first, each into the bin where the product of its vector and the free
capacity is highest, among those it fits into.

First the groups are dealt into yards by hash, and a task packs the groups of a yard
into as many bins as there are shards; a yard has ``YARD_GROUPS`` groups or so, however
many there are.  A bin's vector is close to an equal share of its yard in all three
measures.  Bins of several yards are one bundle, so there are at most ``YARDS``
bundles to a shard.  Then the bundles are packed into the shards, together with the
groups that make up more than a ``HEAVY``-th of an average shard in any measure; there
are few of these, because their shares add up to all.

Only a group larger than a whole shard is parted, by hash of its documents: it
could not be balanced otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fadeline.llm.order import numbered
from fadeline.llm.text import text_of, word_count
from fadeline.session import staged

SHARDS, YARDS, YARD_GROUPS, HEAVY, PARTS = 16, 512, 50_000, 64, 8
MEASURES = ("size", "tokens", "n_rows")


def placed(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector; the capacity of a shard is an equal share of the sum.

    What fits nowhere goes to the shard with the most room in the first measure."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total / shards, 1)  # in parts of a shard
    free = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share.sum(axis=1), -share.max(axis=1))):
        left = free - share[i]
        fits = (left >= -1e-9).all(axis=1)
        worth = np.where(fits, np.round(free @ share[i], 12), -np.inf) if fits.any() else np.round(left[:, 0], 12)
        shard = out[i] = int(np.argmax(worth))
        free[shard] = left[shard]
    return out


def measured(documents: DataFrame) -> DataFrame:
    """The few columns that sharding needs; a null text counts as empty."""
    text = text_of("text")
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_group"),
    )


def bundled(groups: DataFrame, shards: int) -> DataFrame:
    """text_group and bundle: each yard's groups packed by a task."""
    cells = YARDS
    yards = max(cells, math.ceil(groups.count() / YARD_GROUPS))

    def pack(key: tuple, yard: pd.DataFrame) -> pd.DataFrame:
        yard = yard.sort_values("text_group", ignore_index=True)
        bins = placed(yard[list(MEASURES)].to_numpy(float), shards)
        bundle = key[0] % cells * shards + (bins + key[0] // cells) % shards
        return pd.DataFrame({"text_group": yard["text_group"], "bundle": bundle.astype(str)})

    dealt = groups.select("text_group", *MEASURES, F.pmod(F.xxhash64("text_group"), F.lit(yards)).cast("long").alias("yard"))
    return dealt.groupBy("yard").applyInPandas(pack, "text_group string, bundle string")


def in_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (of ``measured``) with ``shard``; rows of equal texts go together, unless
    these are more than a shard; the same rows give the same shards."""
    spark = rows.sparkSession
    groups = staged(rows.groupBy("text_group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")))
    total = groups.agg(*(F.sum(m).alias(m) for m in MEASURES)).first()
    share = F.greatest(*(F.col(m) / F.lit(max(1, total[m] or 0) / shards) for m in MEASURES))
    shared = groups.withColumn("share", share)
    heavy = shared.filter(F.col("share") * HEAVY > 1)
    # no more than 3 * shards * HEAVY rows: each is that part of a measure
    own = heavy.select("text_group", F.when(F.col("share") > 1, F.ceil(F.col("share") * PARTS)).otherwise(1).cast("int").alias("parts")).collect()
    alone = spark.createDataFrame([(r.text_group, r.parts) for r in own], "heavy_group string, parts int")
    light = staged(bundled(shared.filter(F.col("share") * HEAVY <= 1), shards)).withColumnRenamed("text_group", "light_group")
    part = F.concat_ws("/", "text_group", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("string"))
    marked = rows.join(F.broadcast(alone), F.col("text_group") == F.col("heavy_group"), "left")
    # a group that is not heavy has few rows, so no task of this join has many
    light_rows = marked.filter("parts IS NULL").join(light, F.col("text_group") == F.col("light_group")).select(*rows.columns, F.col("bundle").alias("item"))
    tagged = light_rows.unionByName(marked.filter("parts IS NOT NULL").select(*rows.columns, part.alias("item")))
    sums = tagged.groupBy("item").agg(*(F.sum(F.lit(1) if m == "n_rows" else F.col(m)).alias(m) for m in MEASURES))
    items = sorted((r["item"], *(float(r[m]) for m in MEASURES)) for r in sums.collect())  # YARDS * shards bundles and the parts of what is heavy
    shard = placed(np.array([i[1:] for i in items]).reshape(len(items), len(MEASURES)), shards)
    where = spark.createDataFrame([(i[0], int(s)) for i, s in zip(items, shard)], "placed_item string, shard int")
    # as many rows as were placed: bounded by YARDS, shards and HEAVY
    return tagged.join(F.broadcast(where), F.col("item") == F.col("placed_item")).select(*rows.columns, "shard")


def report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each document; slots count from 0 without gaps.

    Null and empty texts are one group of size 1 a row; equal rows are rows of their
    own; documents without an id are dealt like others; other columns are left out.
    """
    sharded = in_shards(staged(measured(documents)), shards)
    dealt = F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_group")), 1, 2)
    slots = numbered(sharded.withColumn("dealt", dealt), ["shard"], ["dealt"], [F.col("doc_id"), F.col("text_group")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
