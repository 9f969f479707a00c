"""Near-duplicate documents: weighted samples in bands, verified by weighted Jaccard.

Equal texts are folded first, so all that follows is about distinct texts.  Texts
whose samples agree in a band meet in that band's bucket.  Every pair of a bucket
is compared unless it cannot change the classes, but no pair is ever a row: a bucket
is dealt into blocks of ``BLOCK`` texts and ``BLOCK_BYTES`` bytes or so, and two blocks
(or one with itself) are a group in which a task holds the texts and tells which are
similar.  It reports a forest of links, not all of them.  Buckets that hold the same
texts in several bands are one.  The classes are the connected components of the links.

A bucket of several blocks is first held against one of its texts, the leader, which
goes to each block while all others are sent once.  Texts similar to the leader are
linked by that, so no two of them need be compared.  One minus the similarity is a
metric: a text at a distance d from the leader can only be similar to texts between
d - 0.2 and d + 0.2.  So what is left to compare are the texts that are not similar to
the leader, with one another and with those at its edge; in a bucket of copies of one
text there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fadeline.llm import weighted_sampling as sampling
from fadeline.llm.text import map_texts, slices, text_of, unused
from fadeline.session import staged

SIMILARITY = 0.8
#: Texts and bytes of a block, about.
BLOCK, BLOCK_BYTES = 200, 4 << 20


def bucket_idf(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of word buckets, over all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(1 << sampling.BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    frequency[np.unique(sampling.buckets(sampling.word_hashes(text)))] += 1
        found = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(frequency[found])], names=["bucket", "n"])

    counts = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(1 << sampling.BUCKET_BITS)
    rows = counts.toPandas()  # 2**16 rows at most
    frequency[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return sampling.idf(texts.count(), frequency)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the text's key; a null text counts as empty."""
    return documents.select("doc_id", text_of("text").alias("text")).withColumns({"key": F.md5("text"), "bytes": F.octet_length("text").cast("long")})


def sampled(documents: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, key, bytes and the hash of each band."""
    sent = documents.sparkSession.sparkContext.broadcast(idf)

    def make():
        return lambda texts: ((sampling.bands(*sampling.profile(t, sent.value)),) for t in texts)

    return map_texts(keyed(documents), "text", make, {"bands": ("array<long>", pa.list_(pa.int64()))}, drop=["text"])


def crowded(texts: DataFrame) -> DataFrame:
    """bucket, key, leader and number of blocks of the buckets with two texts or more;
    of buckets that hold the same texts one."""
    entries = texts.select("key", "bytes", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("key")
    buckets = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(mark.cast("decimal(20,0)")).alias("total"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("mixed"), F.min("key").alias("leader"),
    )
    chosen = buckets.filter("n > 1").groupBy("n", "bytes", "total", "mixed", "leader").agg(F.min("bucket").alias("bucket"))
    return entries.select("bucket", "key").join(chosen.select("bucket", "leader", blocks_of("n", "bytes").alias("blocks")), "bucket")


def blocks_of(n: str, n_bytes: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(n_bytes) / BLOCK_BYTES), F.lit(1)).cast("int")


def text_of_keys(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text, once for each wanted (key, rep)."""
    asked = wanted.select(F.col("key").alias("wanted_key"), F.col("rep").alias("wanted_rep"))
    found = keyed(documents).join(asked, (F.col("key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_rep")), "left_semi")
    return found.select("key", "text").dropDuplicates(["key"])


class Forest:
    """Union by smaller number."""

    def __init__(self, n: int):
        self._up = list(range(n))

    def top(self, i: int) -> int:
        while self._up[i] != i:
            self._up[i] = self._up[self._up[i]]
            i = self._up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = sorted((self.top(a), self.top(b)))
        self._up[b] = a
        return a != b


def linked(profiles: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with a similarity of SIMILARITY or more that join all such pairs.

    ``side``: 0 or 1; pairs within a side are compared only if there is one side.
    One text at a time is spread over the shingles of all, and compared with all
    others at once.
    """
    n = len(profiles)
    lengths = np.array([len(p[0]) for p in profiles])
    total = np.array([p[1].sum() for p in profiles])
    shingles = np.concatenate([p[0] for p in profiles])
    weights = np.concatenate([p[1] for p in profiles])
    _, place = np.unique(shingles, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    spread = np.zeros(place.max() + 1)
    two, order = side.any() and not side.all(), np.arange(n)
    forest, out = Forest(n), []
    for x in range(n):
        own = slice(starts[x], starts[x + 1])
        spread[place[own]] = weights[own]
        shared = np.add.reduceat(np.minimum(spread[place], weights), starts[:-1])
        spread[place[own]] = 0
        close = shared >= SIMILARITY * (total + total[x] - shared)
        for y in np.flatnonzero(close & (order > x) & ((side != side[x]) | (not two))).tolist():
            if forest.join(x, y):
                out.append((x, y))
    return out


def own_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("key", "bucket"), F.col(blocks)).cast("int")


def distances(members: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """bucket, key, leader, bytes and the distance from the leader of the texts of all
    buckets with several blocks.  Each text is sent once, the leader to every block."""
    sent = members.sparkSession.sparkContext.broadcast(idf)
    block = F.when(F.col("key") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own_block("blocks")))
    dealt = members.filter("blocks > 1").select("bucket", "key", "leader", F.explode(block).alias("block"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = group["key"] == group["leader"]
        leader = sampling.profile(group.loc[first, "text"].iloc[0], sent.value)
        group = group[~first]
        away = [1 - sampling.similarity(leader, sampling.profile(t, sent.value)) for t in group["text"]]
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in group["text"]]
        return pd.DataFrame({"bucket": group["bucket"], "key": group["key"], "leader": group["leader"], "bytes": np.array(sizes, np.int64), "away": np.array(away, float)})

    return dealt.join(texts, "key").groupBy("bucket", "block").applyInPandas(compare, "bucket long, key string, leader string, bytes long, away double")


def block_pairs(members: DataFrame, away: DataFrame) -> DataFrame:
    """bucket, key, i, j and side: the two blocks of each group that a text goes to.

    Buckets of one block are a group.  In the others the texts that are not similar to
    the leader are in the blocks 0, 1, ..., and each of these meets itself, those after
    it, and the blocks -1, -2, ... of the texts similar to the leader that may be
    similar to one of them.  A text has ``side`` 1 in a group if its block is the second.
    """
    alone = members.filter("blocks = 1").select("bucket", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    far = F.col("away") > 1 - SIMILARITY
    nearest = away.filter(far).groupBy("bucket").agg(F.min("away").alias("nearest"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("n_bytes"))
    edge = away.filter(~far).join(nearest.select("bucket", "nearest"), "bucket").filter(F.col("away") >= F.col("nearest") - (1 - SIMILARITY) - 1e-9)
    at_edge = edge.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("n_bytes"))
    inner = nearest.select("bucket", blocks_of("n", "n_bytes").alias("blocks"))
    outer = at_edge.select("bucket", blocks_of("n", "n_bytes").alias("edge_blocks"))
    others = F.sequence(-F.coalesce("edge_blocks", F.lit(0)), F.col("blocks") - 1)  # with every block, its own included
    apart = away.filter(far).join(inner.join(outer, "bucket", "left"), "bucket").select("bucket", "key", own_block("blocks").alias("block"), F.explode(others).alias("other"))
    close = edge.select("bucket", "key").join(inner.join(outer, "bucket"), "bucket").select("bucket", "key", (-1 - own_block("edge_blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = apart.unionByName(close).select("bucket", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return alone.unionByName(met)


def links(members: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b: keys of similar texts, enough of them to join all that are."""
    sent = members.sparkSession.sparkContext.broadcast(idf)
    away = staged(distances(members, texts, idf))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        pairs = linked([sampling.profile(t, sent.value) for t in group["text"]], group["side"].to_numpy())
        keys = group["key"].to_numpy()
        return pd.DataFrame({"a": [keys[x] for x, _ in pairs], "b": [keys[y] for _, y in pairs]}, dtype=object)

    to_leader = away.filter(F.col("away") <= 1 - SIMILARITY).select(F.col("leader").alias("a"), F.col("key").alias("b"))
    between = block_pairs(members, away).join(texts, "key").groupBy("bucket", "i", "j").applyInPandas(compare, "a string, b string")
    return to_leader.unionByName(between)


def components(edges: DataFrame) -> DataFrame:
    """key and label of all keys in ``edges`` (a, b): the smallest key that links lead to.

    Each round a key takes the smallest label of its neighbours, and then that
    label's own label; the rounds' tables are written to the work folder.
    """
    both = staged(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("key"), "label"))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["key"] == near["a"]).select("key", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("key").alias("new"), F.col("label").alias("beyond"))
        moved = staged(lower.join(jump, "new").select("key", F.least("new", "beyond").alias("label"), (F.least("new", "beyond") != F.col("label")).alias("moved")))
        labels = moved.select("key", "label")
        if not moved.filter("moved").head(1):
            return labels


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_rows and kept of each row.

    ``class_id`` is the smallest doc_id of the class, null if none has one; ``kept``
    says that the row's doc_id and text are those of the class that stay (the
    smallest doc_id, of its texts the one with the smallest key).  A null text
    counts as empty; texts without words are only similar to equal ones.
    """
    docs = documents.select("doc_id", text_of("text").alias("text"))
    idf = bucket_idf(docs)
    rows = staged(sampled(docs, idf))
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    members = staged(crowded(texts.select("key", "bytes", "bands")))
    wanted = members.select("key").distinct().join(texts.select("key", "rep"), "key")
    found = components(links(members, staged(text_of_keys(docs, wanted)), idf))
    own = texts.select("key", "rep", "copies").join(found, "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("key"))).alias("first")
    of_class = own.groupBy("label").agg(first, F.sum("copies").alias("class_rows"))
    named = own.join(of_class, "label").select("key", F.col("first.rep").alias("class_id"), F.col("first.key").alias("class_key"), "class_rows")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "class_rows", kept.alias("kept"))


def report(documents: DataFrame) -> DataFrame:
    """Class of every row, see ``classes``: null and empty texts are one class, rows
    without an id are in classes like others, equal rows are rows of their own; other
    columns are left out."""
    return classes(documents).select("doc_id", "class_id", "class_rows", "kept")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``documents``.

    Of repeated rows (equal doc_id and text) the one with the smallest other
    columns stays.
    """
    key, times = unused(documents, "text_key"), unused(documents, "key_rows")
    stay = classes(documents).filter("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias(times)).withColumnsRenamed({"doc_id": "stay_id", "key": "stay_key"})
    keyed_rows = documents.withColumn(key, F.md5(text_of("text")))
    # rows join on the text's key alone: null ids join, and equal keys are equal texts
    joined = keyed_rows.join(stay, (F.col(key) == F.col("stay_key")) & F.col("doc_id").eqNullSafe(F.col("stay_id"))).drop("stay_id", "stay_key")
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text") and documents.schema[c].dataType.typeName() != "map"]
    rank = unused(documents, "key_rank")
    repeated = joined.filter(F.col(times) > 1).withColumn(rank, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(*(others or [F.lit(0)])))).filter(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return joined.filter(F.col(times) == 1).select(*columns).unionByName(repeated.select(*columns))
