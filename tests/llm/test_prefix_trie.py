"""The trie against dictionaries of all beginnings."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fadeline.llm import prefix_trie
from fadeline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes as the contract words them; ids are not null and turn numbers differ."""
    original = defaultdict(list)
    for c, turn, role, text in rows:
        original[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    original = {c: [t for _, t in sorted(turns)] for c, turns in original.items()}
    built = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(original.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[c] for c in children[path]]
        sums[path] = (sum(n for n, _ in below) or 1, own + sum(s for _, s in below))
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(seed, n, words, longest):
    """Few different turns, so that beginnings meet often."""
    state, rows = seed, []
    for c in range(n):
        for turn in range((state := state * 1103515245 + 12345 & 0x7FFFFFFF) % (longest + 1)):
            state = state * 1103515245 + 12345 & 0x7FFFFFFF
            rows.append((c, turn * 3 - 5, "user" if turn % 2 else None, None if state % 7 == 0 else f"é{state // 8 % words}"))
    return rows


@pytest.mark.parametrize("seed, n, words, longest", [(1, 60, 2, 7), (2, 40, 1, 25), (3, 80, 5, 3)])
def test_against_dictionaries(spark, seed, n, words, longest):
    rows = conversations(seed, n, words, longest)
    assert nodes(prefix_trie.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_long_conversations_are_summed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 3)
    rows = conversations(4, 30, 1, 40) + [(c, t, "user", "x") for c in range(1000, 1040) for t in range(20)]
    assert nodes(prefix_trie.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_copies_are_one_path(spark):
    """A thousand copies of a long conversation need no round, and each keeps its id."""
    rows = spark.range(0, 5000, 5).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<long>")).alias("turn"))
    rows = rows.select("conv_id", "turn", F.lit("user").alias("role"), F.concat(F.lit("t"), "turn").alias("text"))
    got = nodes(prefix_trie.report(rows))
    assert got == plain([tuple(r) for r in rows.collect()])
    assert len(got) == 31 and {r[3] for r in got} == {1000}


def test_rounds_are_as_many_as_shared_turns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(prefix_trie, "new_path", lambda spark, label, make=prefix_trie.new_path: written.append(make(spark, label)) or written[-1])
    rows = [(5, t, "user", f"a{t}") for t in range(200)] + [(10, t, "user", f"a{t}" if t < 2 else f"b{t}") for t in range(200)]
    assert nodes(prefix_trie.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert sorted(r.round for r in spark.read.parquet(f"{written[0]}/found").select("round").distinct().collect()) == [0, 1, 2]


def test_general_trie_of_other_columns(spark):
    df = spark.createDataFrame([("x", 1, "u", "hi"), ("x", 2, "a", "yo"), ("y", 1, "u", "hi")], "who string, nth int, by string, said string")
    got = nodes(prefix_trie.trie(prefix_trie.digested(df, "who", "nth", "by", "said")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([("x", 0, None, 2, 1, 1, 2, sha("")), ("x", 1, "x", 2, 1, 1, 2, sha("y")), ("x", 2, "x", 1, 0, 1, 0, sha("x"))], key=repr)


def test_odd_rows(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "é" * 300_000
    rows = [(5, None, None, long), (5, 2, "user", None), (5, 3, "user", ""), (7, None, "user", "b"), (10, 1, "x", "same"), (15, 1, "x", "same")]
    extra = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows)], SCHEMA + ", conv int, digest string")
    assert nodes(prefix_trie.report(extra)) == plain(rows)
    # turns of equal numbers and repeated rows are turns of their own, in an order that does not change
    ties = [(5, 1, "u", "a"), (5, 1, "u", "a"), (5, 1, "u", "b"), (10, 1, "u", "b"), (10, 1, "u", "a"), (10, 1, "u", "a")]
    one, other = (nodes(prefix_trie.report(spark.createDataFrame(rows, SCHEMA).repartition(3))) for rows in (ties, ties[::-1]))
    assert one == other and [r[3] for r in one] == [2] * 4
    # rows without an id: a conversation of its own
    got = nodes(prefix_trie.report(spark.createDataFrame([(None, 1, "u", "a"), (None, 2, "u", "b"), (5, 1, "u", "a")], SCHEMA)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(5, 0, None, 2, 1, 1, 1, sha("")), (5, 1, 5, 2, 1, 1, 1, sha("5")), (None, 2, 5, 1, 0, 1, 0, sha(""))], key=repr)


def test_op12_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op12_prefix_trie"](spark, sf_dir)) == plain(rows)


def test_small_tables_cost_few_tasks(spark):
    """Shuffles of 97 partitions, not coalesced, are read by two tasks for each core."""
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = conversations(4, 12, 2, 3)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        turns = prefix_trie.rebuilt(prefix_trie.digested(spark.createDataFrame(rows, SCHEMA)))
        assert turns.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        known = turns.filter("digest is null")
        assert nodes(prefix_trie.trie(turns.unionByName(known))) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
