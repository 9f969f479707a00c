"""The prefix trie of conversations, found by peeling turns off their ends.

A node is a sequence of turns with which conversations begin; the root is the empty
one.  A sequence is named by the sum of 64-bit hashes of (place, turn), two of them
in lanes of 32 bits, so the names of all beginnings are running sums: a long
conversation is summed in chunks, not in one task, and no row holds a whole path.

Equal conversations are merged first and count as one sequence with copies.  Where
only one sequence goes on, nothing can be regrouped: such a tail is taken off at
once, and its nodes' figures follow from the sequence alone.  From the greatest
depth at which two sequences meet, one round per depth then merges the sequences
that end there (tails taken off) with the nodes that survive from the round before,
strips the last turn of each and regroups by what is left.  A round aggregates the
nodes that it finds: a node's subtree is complete when it is found.  Rounds are as
many as turns that two different conversations share, not as the longest has.

Every regrouping sums numbers and is combined before its shuffle, so a beginning
that a third of all conversations share sends a few rows from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fadeline.llm.order import numbered
from fadeline.session import new_path, staged

# Fixed values of the rebuilt conversations: every fifth lends its first turns, h = crc32 % 9 of them.
FAMILY, MOST_LENT = 5, 9

#: Turns of a conversation that are numbered and summed together; ids of one text of ids; parts of a node's children.
CHUNK, ID_CHUNK, SALTS = 1024, 4096, 16

#: Rows of a task that writes a table between two steps.
TASK_ROWS = 100_000

LANES = ("lane_0", "lane_1", "lane_2", "lane_3")
NAME = ("name_1", "name_2")
PARENT = ("parent_1", "parent_2")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows, read by as many tasks as these need, at least two
    for each core: a small table costs no task for each shuffle partition."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def digested(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (0, 1, ... by turn), digest of role and text, and the text's bytes.

    Null turns come first; turns of equal numbers follow one another by their
    digest.  A null role or text is empty, rows without an id are one conversation.
    """
    role_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.substring(F.sha2(F.concat(F.length(role_text[0]).cast("string"), F.lit(":"), *role_text), 256), 1, 32)
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.octet_length(role_text[1]).cast("long").alias("bytes")
    )
    block = rows.withColumn("block", F.floor(F.col("turn") / CHUNK))
    placed = numbered(block, ["conv"], ["block"], [F.col("turn").asc_nulls_first(), F.col("digest")], "at")
    return placed.select("conv", "at", "digest", "bytes")


def lent(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.coalesce(F.crc32(conv.cast("string")) % MOST_LENT, F.lit(0))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``turns`` of conversations whose first turns are those of another.

    Conversation c begins with the first ``lent(c)`` turns of c - c % 5 and goes on
    with its own after as many.  Also one row with a null digest per conversation,
    at place -1, so that those without turns are there.  A conversation without an
    id stays as it is.
    """
    own = staged(turns.withColumn("conv", F.col("conv").cast("long")))
    convs = own.groupBy("conv").agg(F.lit(-1).cast("long").alias("at"))
    is_first = F.coalesce(F.pmod("conv", F.lit(FAMILY)) == 0, F.lit(True))
    lenders = own.filter(is_first & F.col("conv").isNotNull() & (F.col("at") < MOST_LENT - 1))
    to = F.explode(F.sequence(F.lit(1), F.lit(FAMILY - 1)))
    copies = lenders.select(to.alias("k"), "*").withColumn("conv", F.try_add("conv", F.col("k"))).drop("k").filter(F.col("at") < lent(F.col("conv")))
    copies = copies.join(convs.select("conv"), "conv", "left_semi")
    counts = copies.groupBy("conv").agg(F.count(F.lit(1)).alias("got"))
    kept = own.filter(~is_first & (F.col("at") >= lent(F.col("conv")))).join(counts, "conv", "left")
    kept = kept.withColumn("at", F.col("at") - lent(F.col("conv")) + F.coalesce("got", F.lit(0))).drop("got")
    ends = convs.select("conv", "at", F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    # about as many rows as before, five times as many at most
    return sized(own.filter(is_first).unionByName(copies).unionByName(kept).unionByName(ends), own.count())


def packed(lanes: list[Column]) -> list[Column]:
    """Two longs from the last 32 bits of four sums."""
    low = [lane.bitwiseAND(F.lit(0xFFFFFFFF)) for lane in lanes]
    return [F.shiftleft(low[k], 32).bitwiseOR(low[k + 1]) for k in (0, 2)]


def hashed(turns: DataFrame) -> DataFrame:
    """conv, depth (at + 1), bytes and four lanes of the hash of place and digest; zero for the root's rows."""
    hashes = [F.xxhash64(F.lit(seed), F.col("at"), F.col("digest")) for seed in (1, 2)]
    lanes = [lane for h in hashes for lane in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    zero = F.lit(0).cast("long")
    named = {name: F.when(F.col("digest").isNull(), zero).otherwise(lane) for name, lane in zip(LANES, lanes)}
    return turns.withColumns(named).select("conv", (F.col("at") + 1).alias("depth"), "bytes", *LANES)


def beginnings(rows: DataFrame) -> DataFrame:
    """One row per conversation and depth: the names of the sequence so far and of
    that without the last turn, the bytes of the last turn and of those before it."""
    sums = ["bytes", *LANES]
    chunked = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    inside = Window.partitionBy("conv", "chunk").orderBy("depth")
    local = chunked.withColumns({f"to_{c}": F.sum(c).over(inside) for c in sums})
    totals = local.groupBy("conv", "chunk").agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("conv").alias("of"), F.col("chunk").alias("nth"), *(F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"start_{c}") for c in sums))
    joined = local.join(starts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("nth")))
    through = {c: F.col(f"to_{c}") + F.col(f"start_{c}") for c in sums}
    names = packed([through[c] for c in LANES])
    parents = packed([through[c] - F.col(c) for c in LANES])
    return joined.select(
        "conv", "depth", *(n.alias(a) for n, a in zip(names, NAME)), *(n.alias(a) for n, a in zip(parents, PARENT)),
        "bytes", (through["bytes"] - F.col("bytes")).alias("bytes_before"),
    )


def digests_of_ids(ended: DataFrame) -> DataFrame:
    """name and ends_sha256 of every node at which conversations end.

    The ids are joined in texts of ID_CHUNK at most; a task reads a node's texts in
    order and keeps the state of the digest only, so thousands of copies are no group
    in memory.  A null id is empty and comes first.
    """
    part = F.col("conv").cast("decimal(38,0)") if "string" not in dict(ended.dtypes)["conv"] else F.col("conv")
    chunk = F.floor(part / ID_CHUNK) if "string" not in dict(ended.dtypes)["conv"] else F.substring(F.col("conv"), 1, 8)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("conv").isNotNull(), "conv"))), lambda c: F.coalesce(c["conv"].cast("string"), F.lit("")))
    texts = ended.groupBy(*NAME, chunk.alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for one, two, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (one, two) != name:
                    if state:
                        done.append((*name, state.hexdigest()))
                    name, state = (one, two), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), row)) for row in done], schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), (*name, state.hexdigest())))], schema=schema)

    schema = pa.schema([*((n, pa.int64()) for n in NAME), ("ends_sha256", pa.string())])
    ordered = texts.repartition(*NAME).sortWithinPartitions(*NAME, F.col("chunk").asc_nulls_first())
    return ordered.select(*NAME, "ids").mapInArrow(run, ", ".join([*(f"{n} long" for n in NAME), "ends_sha256 string"]))


def peeled(nodes: DataFrame) -> DataFrame:
    """The nodes at which several sequences meet, with n_children, n_leaves and
    saved_tokens, from the deepest to the root.

    ``nodes`` has these figures for the tails.  Each round's nodes are a written
    table: a lost executor repeats a round at most.
    """
    spark, path = nodes.sparkSession, new_path(nodes.sparkSession, "peeled")
    meeting = F.col("sequences") > 1
    met_at = {r["depth"]: r["count"] for r in nodes.filter(meeting).groupBy("depth").count().collect()}  # a row for each depth
    deepest = max(met_at, default=None)
    figures = ["n_children", "n_leaves", "saved_tokens"]
    own = ["depth", "conv_id", "n_convs", "bytes", *PARENT]

    def stripped(found: DataFrame) -> DataFrame:
        """What nodes give to those without their last turn."""
        return found.select(*(F.col(p).alias(n) for p, n in zip(PARENT, NAME)), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")

    def regrouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*NAME).agg(*(F.max(c).alias(c) for c in own), *(F.sum(c).alias(c) for c in figures))

    if deepest is None:
        return nodes.filter(meeting)
    zeros = {c: F.lit(0).cast("long") for c in figures}
    base = nodes.filter(meeting).withColumns(zeros).select(*NAME, *own, *figures)
    tails = stripped(nodes.filter(~meeting & (F.col("depth") <= deepest + 1) & (F.col("depth") > 0)))
    met = regrouped(base.unionByName(tails, allowMissingColumns=True)).filter(F.col("depth").isNotNull())
    sized(met, sum(met_at.values())).withColumn("entry", F.col("depth")).write.partitionBy("entry").parquet(f"{path}/met")
    met, survivors = spark.read.parquet(f"{path}/met"), None
    for depth in range(deepest, -1, -1):
        rows = met.filter(F.col("entry") == depth).drop("entry")
        if survivors is not None:
            rows = sized(regrouped(rows.unionByName(stripped(survivors), allowMissingColumns=True)), met_at[depth])
        found = rows.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"))
        found.write.parquet(f"{path}/found/round={depth}")
        survivors = spark.read.schema(found.schema).parquet(f"{path}/found/round={depth}")
    return spark.read.parquet(f"{path}/found").drop("round")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all beginnings of the conversations in ``turns``, as ``digested``
    or ``rebuilt`` make them (conv, at, digest, bytes; a row with a null digest at
    place -1 makes a conversation known that has no turns, and changes no other).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  Without conversations
    there are no nodes, not even the root.  A member without an id comes after all
    others.
    """
    rows = staged(hashed(turns))
    n_rows = rows.count()
    ended = rows.groupBy("conv").agg(F.max("depth").alias("n"), F.sum("bytes").alias("total"), *(F.sum(c).alias(c) for c in LANES))
    ended = staged(sized(ended.select("conv", "n", "total", *(c.alias(a) for c, a in zip(packed([F.col(c) for c in LANES]), NAME))), n_rows))
    sequences = ended.groupBy(*NAME).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("total").alias("total")).drop(*NAME)
    members = beginnings(rows.filter("depth > 0")).join(sequences, F.col("conv").eqNullSafe(F.col("rep")))
    zero = F.lit(0).cast("long")
    roots = sequences.select(F.col("rep").alias("conv"), *(zero.alias(c) for c in ("depth", *NAME, *PARENT, "bytes", "bytes_before")), "*")
    nodes = staged(sized(
        members.unionByName(roots).groupBy(*NAME).agg(
            F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("sequences"),
            *(F.max(c).alias(c) for c in (*PARENT, "bytes", "bytes_before", "n", "total")),
        ).select(
            "*", (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * (F.col("total") - F.col("bytes_before"))).alias("saved_tokens"),
        ), n_rows
    ))
    kept = [*NAME, *PARENT, "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = peeled(nodes).select(*kept)
    every = nodes.filter("sequences = 1").select(*kept).unionByName(shared)
    # a parent may have a third of all nodes as children: they are dealt over SALTS parts
    salt = F.pmod(F.xxhash64(*NAME), F.lit(SALTS)).cast("int")
    parents = shared.select(*(F.col(n).alias(f"of_{n}") for n in NAME), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"), F.lit(True).alias("met"))
    of = (F.col("salt") == F.col("of_salt")) & (F.col("depth") > 0)
    for p, n in zip(PARENT, NAME):
        of &= F.col(p) == F.col(f"of_{n}")
    named = every.withColumn("salt", salt).join(parents, of, "left")
    parent = F.when(F.col("met"), F.col("parent_conv_id")).when(F.col("depth") > 0, F.col("conv_id"))
    with_ends = named.withColumn("parent_conv_id", parent).join(digests_of_ids(ended.select(*NAME, "conv")), list(NAME), "left")
    return with_ends.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def report(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Null turns come first, null roles and texts are empty, rows without an id are a
    conversation of their own that takes no turns from others; repeated rows are
    turns of their own.  Other columns are left out.
    """
    return trie(rebuilt(digested(df)))


ORACLE = r"""
WITH crc_table AS (
  SELECT list(crc ORDER BY byte) AS entries FROM (
    SELECT byte, list_reduce(list_prepend(byte, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
    FROM (SELECT unnest(range(256))::BIGINT AS byte)
  )
), ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
  FROM conversations
), original AS (
  SELECT conv_id, list(turn ORDER BY place) AS turns FROM ordered GROUP BY conv_id
), cuts AS (
  SELECT conv_id, turns,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]))) % 9 AS h
  FROM original, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cuts c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends
  FROM prefixes GROUP BY ALL
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.path[depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON n.path = c.path
), sums AS (
  SELECT path[1:up] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path
LEFT JOIN full_nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
