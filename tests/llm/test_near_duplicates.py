"""Samples, links and classes against plain comparison of all pairs."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadeline.llm import near_duplicates as near, weighted_sampling as sampling
from fadeline.llm.queries import QUERIES


def words(chance, n):
    return ["".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 7))) for _ in range(n)]


def variants(chance, n, length=150, most=9):
    """Copies of one text with some words changed."""
    base = words(chance, length)
    out = []
    for _ in range(n):
        own = list(base)
        for place in chance.sample(range(length), chance.randint(0, most)):
            own[place] = words(chance, 1)[0]
        out.append(" ".join(own))
    return out


def plain_profile(text, idf):
    """Shingles as texts with tf times mean idf."""
    own = [w.encode() for w in text.split()]
    weight = [float(idf[sampling.buckets(sampling.word_hashes(w.decode()))[0]]) for w in own]
    n = min(5, len(own))
    out = {}
    for i in range(len(own) - n + 1 if n else 0):
        key = tuple(own[i : i + n])
        out[key] = out.get(key, 0.0) + sum(weight[i : i + n]) / n
    return out


def plain_similarity(a, b):
    shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


IDF = sampling.idf(100, np.arange(1 << 16) % 100)


def test_profiles_and_similarity():
    chance = random.Random(5)
    texts = variants(chance, 6) + [" ".join(words(chance, n)) for n in (0, 1, 4, 5, 6)] + ["a b c d e " * 40, "x " * 9]
    for a, b in itertools.combinations(texts, 2):
        want = plain_similarity(plain_profile(a, IDF), plain_profile(b, IDF))
        assert abs(sampling.similarity(sampling.profile(a, IDF), sampling.profile(b, IDF)) - want) < 1e-9


def test_samples_agree_as_often_as_texts_are_similar():
    chance = random.Random(6)
    sums = np.zeros(2)
    for _ in range(60):
        a, b = (sampling.profile(t, IDF) for t in variants(chance, 2, 100, 12))
        (s, t), (u, v) = sampling.samples(*a), sampling.samples(*b)
        sums += [np.mean((s == u) & (t == v)), sampling.similarity(a, b)]
    assert abs(sums[0] - sums[1]) / 60 < 0.03


def test_samples_do_not_depend_on_slices():
    p = sampling.profile(" ".join(words(random.Random(7), 3000)), IDF)
    for a, b in zip(sampling.samples(*p), sampling.samples(*p, at_once=100)):
        assert (a == b).all()


def test_links_are_a_forest_of_all_similar_pairs():
    chance = random.Random(8)
    profiles = [sampling.profile(t, IDF) for t in variants(chance, 25) + variants(chance, 10, 40) + ["a b"]]
    for side in (np.zeros(36, int), np.arange(36) % 2):
        pairs = {(x, y) for x, y in itertools.combinations(range(36), 2) if sampling.similarity(profiles[x], profiles[y]) >= 0.8 and (not side.any() or side[x] != side[y])}
        got = near.linked(profiles, side)
        assert set(got) <= pairs
        all_of, of_got = near.Forest(36), near.Forest(36)
        for x, y in pairs:
            all_of.join(x, y)
        for x, y in got:
            assert of_got.join(x, y)
        assert [all_of.top(i) for i in range(36)] == [of_got.top(i) for i in range(36)]


def test_samples_of_very_long_texts():
    """Texts with more shingles than the tables have draws agree as often as they are similar."""
    chance, sums = random.Random(12), np.zeros(2)
    for part in (0.05, 0.02, 0.01):
        base = [f"w{chance.randrange(10**7)}" for _ in range(100_000)]
        other = [w if chance.random() > part else f"v{chance.randrange(10**7)}" for w in base]
        a, b = (sampling.profile(" ".join(t), IDF) for t in (base, other))
        (s, t), (u, v) = sampling.samples(*a), sampling.samples(*b)
        sums += [np.mean((s == u) & (t == v)), sampling.similarity(a, b)]
    assert abs(sums[0] - sums[1]) / 3 < 0.1  # 144 samples in all


def test_a_bucket_of_copies_sends_each_text_once(spark):
    """5,000 texts of one bucket that are similar to its leader: no two blocks meet."""
    chance = random.Random(10)
    texts = [f"{t} {i}" for i, t in enumerate(variants(chance, 60, 300, 2) * 84)][:5000]
    df = spark.createDataFrame([(hash_of(t), t) for t in texts], "key string, text string")
    idf = sampling.idf(100, np.full(1 << 16, 50))
    members = df.select(F.lit(1).cast("long").alias("bucket"), "key", F.lit(min(hash_of(t) for t in texts)).alias("leader"), F.lit(25).alias("blocks"))
    away = near.staged(near.distances(members, df, idf))
    assert away.count() == 4999 and away.filter("away > 0.2").count() == 0
    assert near.block_pairs(members, away).count() == 0
    links = near.links(members, df, idf).collect()
    assert len(links) == 4999 and {r.a for r in links} == {min(hash_of(t) for t in texts)}


def hash_of(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("most, by_bytes", [(3, False), (9, False), (20, False), (40, False), (20, True)])
def test_leaders_lose_no_class(spark, monkeypatch, most, by_bytes):
    """Buckets in which few, some or most texts are similar to the leader, against all pairs."""
    monkeypatch.setattr(near, "BLOCK", 10**6 if by_bytes else 9)
    monkeypatch.setattr(near, "BLOCK_BYTES", 9_000 if by_bytes else 1 << 20)
    chance = random.Random(most)
    texts = list(dict.fromkeys(variants(chance, 90, 150, most) + variants(chance, 30, 150, 4)))
    df = spark.createDataFrame([(hash_of(t), t) for t in texts], "key string, text string")
    idf = sampling.idf(100, np.full(1 << 16, 50))
    profiles = {hash_of(t): sampling.profile(t, idf) for t in texts}
    keys = sorted(profiles)
    members = df.select(F.lit(1).cast("long").alias("bucket"), "key", F.lit(keys[0]).alias("leader"), F.octet_length("text").alias("bytes"))
    sizes = members.agg(F.count("key").alias("n"), F.sum("bytes").alias("bytes")).select(near.blocks_of("n", "bytes").alias("b")).first()["b"]
    assert sizes > 5
    found = near.links(members.select("bucket", "key", "leader", F.lit(sizes).alias("blocks")), df, idf).collect()
    place = {k: i for i, k in enumerate(keys)}
    want, got = near.Forest(len(keys)), near.Forest(len(keys))
    for x, y in itertools.combinations(keys, 2):
        if sampling.similarity(profiles[x], profiles[y]) >= 0.8:
            want.join(place[x], place[y])
    for r in found:
        assert sampling.similarity(profiles[r.a], profiles[r.b]) >= 0.8 - 1e-9
        got.join(place[r.a], place[r.b])
    assert [want.top(i) for i in range(len(keys))] == [got.top(i) for i in range(len(keys))]


def test_classes_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 10)
    chance = random.Random(9)
    texts = variants(chance, 120) + variants(chance, 30, 80, 5) + [" ".join(words(chance, 50)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i % 7]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    idf = near.bucket_idf(df)
    forest = near.Forest(len(docs))
    profiles = [sampling.profile(t, idf) for _, t in docs]
    for x, y in itertools.combinations(range(len(docs)), 2):
        if docs[x][1] == docs[y][1] or sampling.similarity(profiles[x], profiles[y]) >= 0.8:
            forest.join(x, y)
    got = {r.doc_id: r for r in near.report(df).collect()}
    assert len(got) == len(docs)
    assert {i: got[i].class_id for i, _ in docs} == {docs[x][0]: docs[forest.top(x)][0] for x in range(len(docs))}
    for r in got.values():
        assert r.kept == (r.doc_id == r.class_id)
        assert r.class_rows == sum(o.class_id == r.class_id for o in got.values())
    kept = near.without_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in got.items() if r.kept)


def test_odd_rows(spark):
    long = " ".join(words(random.Random(1), 20_000))
    rows = [
        (1, None, "b"), (2, "", "a"), (3, " ", "a"), (4, "one two", "a"), (5, "one  two", "a"), (6, "one two", "a"), (None, "one two", "a"),
        (7, long, "z"), (7, long, "y"), (8, long + " more", "y"), (None, "nobody", "a"), (None, "nobody", "b"), (9, "two one", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("kept", F.lit(7))
    got = {(r.doc_id, r.class_id, r.class_rows, r.kept) for r in near.report(df).collect()}
    assert got == {
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 4, True), (5, 4, 4, False), (6, 4, 4, False), (None, 4, 4, False),
        (7, 7, 3, True), (8, 7, 3, False), (None, None, 2, True), (9, 9, 1, True),
    }
    kept = near.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.key) for r in kept.collect()), key=str) == sorted([(1, "b"), (3, "a"), (4, "a"), (7, "y"), (None, "a"), (9, None)], key=str)
    assert near.report(df.limit(0)).count() == 0
    assert near.without_near_duplicates(df.limit(0)).count() == 0


def test_op5_rows(spark, sf_dir):
    got = QUERIES["op5_near_duplicates"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    class_of = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(docs) == len(class_of)
    idf = near.bucket_idf(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    profiles = [(d.doc_id, d.text, sampling.profile(d.text, idf)) for d in docs]
    forest = near.Forest(len(docs))
    for (x, (_, s, p)), (y, (_, t, q)) in itertools.combinations(enumerate(profiles), 2):
        if s == t or sampling.similarity(p, q) >= 0.8:
            forest.join(x, y)
    want = {}
    for x, (doc_id, *_) in enumerate(profiles):
        want.setdefault(forest.top(x), []).append(doc_id)
    assert class_of == {i: min(own) for own in want.values() for i in own}
