"""Targets and copies against SQL, and shards against their laws."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import connect, difference
from fadeline.llm import mixing, sharding
from fadeline.llm.queries import ORACLE, QUERIES


def filled_up(sizes):
    """Targets by sharing out again and again; sizes by source in order."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    target, full, left = [0.0] * len(sizes), set(), 1.5 * sum(sizes)
    while True:
        total = sum(w for i, w in enumerate(weight) if i not in full)
        for i, w in enumerate(weight):
            if i not in full:
                target[i] = left * w / total
        over = {i for i in range(len(sizes)) if i not in full and target[i] > 2 * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        full |= over


@pytest.mark.parametrize("sizes", [[10], [5, 900, 3, 20, 1000, 7, 7], [0, 0], [0, 50, 10], [100] * 20, [1, 10**9, 1]])
def test_targets(spark, sizes):
    names = [None if i == len(sizes) - 1 and i else f"s{i:03}" for i in range(len(sizes))]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
    by_name = {r.source: r.target or 0.0 for r in got}
    assert [by_name[n] for n in names] == pytest.approx(filled_up(sizes))


def test_op2_rows(spark, sf_dir):
    assert difference(spark, connect(sf_dir), "op2_mixing", QUERIES["op2_mixing"], ORACLE["op2_mixing"], sf_dir) is None


def test_words_come_near_the_target(spark):
    rows = QUERIES["op2_mixing"](spark, "/root/testdata/sf0.1").groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()
    for r in rows:
        assert abs(r.taken - r.target) <= 0.03 * r.target and r.most <= 2


def test_reruns_agree_however_rows_lie(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.report(d).collect())) for d in (docs, docs.repartition(7).orderBy(F.rand())))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 50_000, None), (3, "w " * 50_000, None), (None, "x y", "b"), (4, "x y z", "b"), (4, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit("mine"), "copies": F.lit(5), "chunk_rows": F.lit(1)})
    got = mixing.report(df).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2)} == {0}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got) and {r.target for r in out.collect()} == {"mine"}
    assert mixing.report(df.limit(0)).count() == 0 == mixing.mixed(df.limit(0)).count()


def check_shards(rows, shards=16):
    bytes_of, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    return [bytes_of[s] for s in range(shards)], groups


def test_op6_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op6_sharding"](spark, folder).collect()
    docs = {d.doc_id: d.text.encode() for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id])) for r in rows)
    sizes, groups = check_shards(rows)
    assert max(sizes) <= 1.02 * min(sizes)
    assert all(len(s) == 1 for s in groups.values())


def plain_placed(vectors, shards):
    """The packing rule in plain Python: shard of each (size, tokens, rows)."""
    capacity = [max(sum(v[m] for v in vectors) / shards, 0) or 1 for m in range(3)]
    share = [[v[m] / capacity[m] for m in range(3)] for v in vectors]
    free, out = [[1.0] * 3 for _ in range(shards)], [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        left = [[f[m] - share[i][m] for m in range(3)] for f in free]
        fitting = [s for s in range(shards) if min(left[s]) >= -1e-9]
        worth = {s: round(sum(f * x for f, x in zip(free[s], share[i])), 12) for s in fitting} if fitting else {s: round(left[s][0], 12) for s in range(shards)}
        out[i] = max(sorted(worth), key=worth.get)
        free[out[i]] = left[out[i]]
    return out


def plain_shards(docs, shards, yards, yard_groups):
    """Shard of each (doc_id, text): groups in yards, bins of yards in bundles, bundles in shards."""
    hashed = lambda key: xxhash.xxh64_intdigest(key.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    vector = lambda text: (len(text.encode()) + 1, len(text.split()), 1)
    groups = {}
    for _, text in docs:
        key = hashlib.md5(text.encode()).hexdigest()
        groups[key] = tuple(a + b for a, b in zip(groups.get(key, (0, 0, 0)), vector(text)))
    total = [sum(g[m] for g in groups.values()) for m in range(3)]
    share = {k: max(g[m] / (max(1, total[m]) / shards) for m in range(3)) for k, g in groups.items()}
    light = {k: g for k, g in groups.items() if share[k] * sharding.HEAVY <= 1}
    n_yards, bundle = max(yards, math.ceil(len(light) / yard_groups)), {}
    for yard in range(n_yards):
        own = sorted(k for k in light if signed(hashed(k)) % n_yards == yard)
        for k, b in zip(own, plain_placed([light[k] for k in own], shards)):
            bundle[k] = str(yard % yards * shards + (b + yard // yards) % shards)
    items, item_of = {}, []
    for doc_id, text in docs:
        key = hashlib.md5(text.encode()).hexdigest()
        parts = math.ceil(share[key] * sharding.PARTS) if share[key] > 1 else 1
        item = bundle.get(key) or f"{key}/{signed(xxhash.xxh64_intdigest(struct.pack('<q', doc_id), 42)) % parts}"
        items[item] = tuple(a + b for a, b in zip(items.get(item, (0, 0, 0)), vector(text)))
        item_of.append(item)
    names = sorted(items)
    shard = dict(zip(names, plain_placed([items[n] for n in names], shards)))
    return {doc_id: shard[item] for (doc_id, _), item in zip(docs, item_of)}


@pytest.mark.parametrize("yards, yard_groups", [(512, 50_000), (4, 50_000), (4, 60)])
def test_shards_against_a_plain_packing(spark, monkeypatch, yards, yard_groups):
    monkeypatch.setattr(sharding, "YARDS", yards)
    monkeypatch.setattr(sharding, "YARD_GROUPS", yard_groups)
    chance = random.Random(3)
    docs = [(i, "the same text") for i in range(300)] + [(300 + i, " ".join(f"w{chance.randrange(10**6)}" for _ in range(int(chance.paretovariate(0.9)) % 900))) for i in range(700)]
    got = sharding.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.shard for r in got} == plain_shards(docs, 16, yards, yard_groups)


def test_many_groups_are_even_in_all_measures(spark):
    """Short texts of many words and long ones of few: rows, tokens and bytes pull apart."""
    rows = spark.range(200_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("a "), (F.col("id") % 40).cast("int"))).when(F.col("id") % 3 == 1, F.repeat(F.lit("longword"), (F.col("id") % 50).cast("int"))).otherwise("").alias("t"),
    ).select("doc_id", F.concat("t", F.col("doc_id").cast("string")).alias("text"))
    sums = sharding.report(rows).groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("doc_id")).collect()
    for measure in range(1, 4):
        own = [r[measure] for r in sums]
        assert len(own) == 16 and max(own) <= 1.05 * min(own)


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text") for i in range(1000)] + [(1000 + i, f"text number {i} " * (i % 9)) for i in range(2000)]
    got = sharding.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes, groups = check_shards(got)
    assert max(sizes) <= 1.05 * min(sizes)
    assert sum(len(s) > 1 for s in groups.values()) == 2  # this text and the empty one are more than a shard's rows
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert counts.max() <= 1.3 * counts.min()


def test_placing_keeps_to_capacity():
    vectors = np.random.default_rng(2).random((3000, 3)) ** 6
    shard = sharding.placed(vectors, 7)
    sums = np.array([vectors[shard == s].sum(axis=0) for s in range(7)])
    assert (sums.max(axis=0) <= 1.05 * sums.mean(axis=0)).all()
    assert len(sharding.placed(np.zeros((0, 3)), 7)) == 0


def test_odd_shard_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 40_000), (3, None)], "doc_id long, text string").withColumns({"shard": F.lit("x"), "item": F.lit(1)})
    got = sharding.report(df).collect()
    assert sorted(((r.doc_id or 0, r.size, r.text_crc32) for r in got)) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 80_001, zlib.crc32(("é" * 40_000).encode())), (3, 1, 0)]
    check_shards(got)
    assert sharding.report(df.limit(0)).count() == 0
