"""The tree and the next document against plain Python."""

import hashlib
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from fadeline.llm import fingerprints, order
from fadeline.llm.queries import QUERIES


def strong(text, n=16):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def plain(text):
    paragraphs = [strong(p) for p in text.split("\n")]
    sections = [strong(s) for s in re.split(r"(?<=[0-3])\.", ".".join(paragraphs))]
    pieces = [f"{xxhash.xxh64_intdigest(p.encode(), 42) & 0xFFFFFFFF:08X}" for p in re.findall(r"[^\n.!?]{1,32}[.!?]*|[.!?]+|\n", text)]
    assert "".join(re.findall(r"[^\n.!?]{1,32}[.!?]*|[.!?]+|\n", text)) == text
    s = ".".join(sections)
    return ":".join([strong(s, 64), s, ".".join(paragraphs), ".".join(pieces)])


def alike(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    a, b = (set(filter(None, x.split(":")[3].split("."))) for x in (a, b))
    return len(a & b) / max(1, len(a | b))


def located(before, after):
    """First differing paragraph, and how many lie between what is equal at both ends."""
    a, b = before.split("\n"), after.split("\n")
    if a == b:
        return None, None, None
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p, len(a) - p - s, len(b) - p - s


def expected(docs):
    """docs: (doc_id, text) by falling id, equal ids by their texts' digests."""
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        one, two = plain(text), plain(edited)
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), one, two, pytest.approx(alike(one, two)), pytest.approx(alike(one, plain(after))), *located(text, edited)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest() if not isinstance(r[1], int) else r[3]))


def test_op9_rows(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op9_fingerprints"](spark, sf_dir).collect()]
    assert ordered(got) == expected(ordered(docs))


@pytest.mark.parametrize("chunks", [2, 100, 1000])
def test_next_over_many_chunks(spark, chunks):
    ids = [7 * i % 500 for i in range(300)] + [None] * 60 + [3] * 90 + [499, 499, -5, 10**15]
    docs = [(i, f"text {k}. of {i}") for k, i in enumerate(ids)] + [(3, "again")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in fingerprints.report(df, chunks).collect()]
    by_sha = lambda x: (x[0] is None, -(x[0] or 0), x[3], x[2])
    assert sorted(got, key=by_sha) == sorted(expected(ordered(docs)), key=by_sha)


def test_hot_ids_are_parted(spark):
    """Rows of one id, or of none, that are most of the table go to many chunks."""
    df = spark.range(6000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") < 5000, F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("tie"))
    found = order.chunked(df, "doc_id", "tie", "chunk", 200)
    largest = lambda rows: rows.groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert largest(found.filter("doc_id = 7")) < 100 and largest(found.filter("doc_id is null")) < 100 and largest(found) < 100
    rows = sorted(found.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert [r.chunk for r in rows] == sorted(r.chunk for r in rows)


def test_driver_work_does_not_grow_with_rows(spark):
    """Bounds are as many as partitions are, for a thousand rows as for millions."""
    seen = []
    for n in (1_000, 2_000_000):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("tie"))
        found = order.chunked(df, "doc_id", "tie", "chunk", 256)
        seen.append(found.select("chunk").distinct().count())
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert seen[0] <= 256 and seen[1] <= 256
    begin = time.perf_counter()
    order.chunked(df, "doc_id", "tie", "chunk", 4096).limit(1).collect()
    assert time.perf_counter() - begin < 60


def test_odd_rows(spark):
    docs = [(5, None), (4, ""), (4, ""), (3, "é🙂" * 30_000), (2, "a\n\nb."), (1, "\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"next_text": F.lit("x"), "chunk": F.lit(1), "of": F.lit(1), "tie": F.lit("t")})
    got = [tuple(r) for r in fingerprints.report(df).collect()]
    assert ordered(got) == ordered(expected(docs))
    assert fingerprints.report(df.limit(0)).count() == 0
    assert fingerprints.report(df.limit(1)).count() == 1
    nobody = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert ordered([tuple(r) for r in fingerprints.report(nobody).collect()]) == ordered(expected(ordered([(None, "a"), (None, "b")])))


def test_edits_are_located(spark):
    long = [f"paragraph {i}" for i in range(200)]
    pairs = [
        ("a\nb\nc\nd", "a\nB\nc\nd\ne"), ("x", "x"), ("a\na\nb", "a\nb"), ("a\nb\nc\nd", "a\nc\nb\nd"), ("", "a"), ("a\nb", ""), ("a\n\n\nb", "a\n\nb"),
        ("\n".join(long), "\n".join(long[:50] + long[51:])), ("\n".join(long), "\n".join(long[:50] + ["new", "more"] + long[50:])),
        ("\n".join(long), "\n".join(long[:20] + long[30:60] + long[20:30] + long[60:])), ("\n".join(long * 2), "\n".join(long * 3)), ("\n".join(long), "\n".join(["0", *long, "9"])),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, one string, two string")
    found = df.select("i", fingerprints.edit(fingerprints.fingerprint(F.col("one")), fingerprints.fingerprint(F.col("two"))).alias("e")).collect()
    assert [tuple(r.e) if r.e else (None, None, None) for r in sorted(found)] == [located(*p) for p in pairs]


@pytest.mark.parametrize("levels", [1, 2])
def test_places_between_bounds(spark, levels):
    bounds = sorted([k * 3 for k in range(16**levels - 3)] + [6, 6])
    df = spark.range(-3, 3 * 16**levels + 5)
    got = df.select("id", order.below(bounds, F.col("id")).alias("less"), order.below(bounds, F.col("id"), or_equal=True).alias("same")).collect()
    assert all((r.less, r.same) == (sum(b < r.id for b in bounds), sum(b <= r.id for b in bounds)) for r in got)


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i % 5, i) for i in range(200)], "g int, c int, v int")
    got = order.numbered(df, ["g"], ["c"], [F.col("v")], "slot").collect()
    assert len(got) == 200
    for g in (None, 0, 1, 2):
        own = sorted((r.c, r.v, r.slot) for r in got if r.g == g)
        assert [s for *_, s in own] == list(range(len(own)))


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = QUERIES["op9_fingerprints"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
