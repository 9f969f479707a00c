"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled rows are the only thing that is sampled: at most ``MAX_EXAMPLES`` of them,
by hash.  Their terms are words, and the first letters of longer words.  The
features are all terms that go with either label: those with a likelihood ratio
beyond what as many chance terms would reach.  Document frequencies are counted
over all documents.

The examples lie in an inverted index whose lists are cut into blocks; each list
has the largest weight of each block.  The sum of these bounds what a block can
score.  The blocks of the best bounds are scored first, then all those whose bound
beats the k-th neighbour so far: the result is that of comparing with all examples.

Neighbours vote with their cosine as weight.  What a vote is worth is learned from
the examples themselves, each without itself (isotonic), so a score is the share of
label 1 among texts with such votes.  A text without any feature, an empty one too,
has no neighbours and gets the share of such examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fadeline.llm.text import LONGEST_KNOWN, Bounded, map_texts, slices, unused, words
from fadeline.session import staged

MAX_EXAMPLES = 20_000
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that are scored before any bound is compared.
FIRST_BLOCKS = 8
#: A feature is in so many examples at least.
LEAST_EXAMPLES = 3
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


def terms(word: bytes) -> tuple[str, ...]:
    """Words of letters in a run of characters, and the first letters of longer ones."""
    out = []
    for w in LETTERS.findall(word.decode("utf-8", "replace").lower()):
        out.append(w)
        out += ["^" + w[:n] for n in PREFIXES if len(w) > n]
    return tuple(out)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples_of(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text, label and doc_id of at most ``most`` labelled rows that are not held
    out.  A document with several labels has the highest; nulls are no label."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .withColumnRenamed("doc_id", "example_id")
    )
    # at most MAX_EXAMPLES rows of two numbers
    return documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("example_id")).select("doc_id", "text", "label")


def chosen_features(examples: DataFrame) -> list[str]:
    """Terms that go with label 1 or with label 0, the strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bounded(terms, 50_000, LONGEST_KNOWN).__getitem__
        n, p = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([p[t] for t in n], pa.int64())], names=["term", "n", "p"])
            n.clear(), p.clear()
            return rows

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(chain.from_iterable(map(known, set(words(text or "")))))
                n.update(own)
                if label:
                    p.update(own)
                if len(n) > 300_000:
                    yield counted()
        yield counted()

    total, positive = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < total:
        return []
    parts = examples.select("text", "label").mapInArrow(count, "term string, n long, p long")
    counted = staged(parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("n") >= LEAST_EXAMPLES))
    n, p, rate = F.col("n"), F.col("p"), positive / total
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    ratio = 2 * (part(p, rate) + part(n - p, 1 - rate))
    tried = max(2, counted.count())
    best = counted.withColumn("ratio", ratio).filter(F.col("ratio") > 2 * math.log(tried)).orderBy(F.desc("ratio"), "term")
    return [r.term for r in best.select("term").collect()]  # no more than the terms of MAX_EXAMPLES texts


class Vectors:
    """Counts of features in texts."""

    def __init__(self, features: list[str]):
        self._number = {f: i for i, f in enumerate(features)}
        self._known = Bounded(self._of, 150_000, LONGEST_KNOWN)

    def _of(self, word: bytes) -> tuple[int, ...]:
        return tuple(self._number[t] for t in terms(word) if t in self._number)

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(feature, occurrences), by feature."""
        return tuple(sorted(Counter(chain.from_iterable(filter(None, map(self._known.__getitem__, words(text or ""))))).items()))


PAIRS = ("array<struct<feature:int,n:int>>", pa.list_(pa.struct([("feature", pa.int32()), ("n", pa.int32())])))


def with_counts(df: DataFrame, features: list[str], into: str) -> DataFrame:
    def make():
        vectors = Vectors(features)
        return lambda texts: (([{"feature": f, "n": n} for f, n in vectors.counts(t)],) for t in texts)

    return map_texts(df, "text", make, {into: PAIRS}, drop=["text"])


def document_frequencies(documents: DataFrame, features: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that have each feature: over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, n, own = Vectors(features), 0, np.zeros(len(features), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    n += 1
                    own[[f for f, _ in vectors.counts(text)]] += 1
        found = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([n, *own[found]], pa.int64())], names=["feature", "n"])

    n, frequency = 0, np.zeros(len(features))
    rows = documents.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # a row per feature, and one for the documents
        if r.feature < 0:
            n = r.n
        else:
            frequency[r.feature] = r.n
    return n, frequency


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges, one range after the other, and the ranges' lengths."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


class BlockMaxIndex:
    """Exact nearest neighbours of sparse unit vectors by dot product."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_features: int, block: int = BLOCK):
        n = len(vectors)
        strongest = [(int(f[np.argmax(w)]), -float(w.max()), i) for i, (f, w) in enumerate(vectors)]
        #: Examples by their strongest feature, so that those of a block are alike.
        self.order = np.array([i for *_, i in sorted(strongest)], np.int64)
        self.block, self.blocks = block, -(-n // block)
        placed = [vectors[i] for i in self.order]
        feature = np.concatenate([np.zeros(0, np.int64), *(f for f, _ in placed)]).astype(np.int64)
        at = np.repeat(np.arange(n), [len(f) for f, _ in placed])
        by_list = np.lexsort((at, feature))
        feature, self._at = feature[by_list], at[by_list]
        self._weight = np.concatenate([np.zeros(0), *(w for _, w in placed)])[by_list]
        #: Where each feature's list begins.
        self._starts = np.searchsorted(feature, np.arange(n_features + 1))
        #: The blocks that each list enters, and its largest weight there; and where each feature's begin.
        entered = np.flatnonzero(np.diff(feature * self.blocks + self._at // block, prepend=-1))
        self._entered = self._at[entered] // block
        self._best = np.maximum.reduceat(self._weight, entered) if len(entered) else np.zeros(0)
        self._best_starts = np.searchsorted(feature[entered], np.arange(n_features + 1))

    def _scored(self, blocks: np.ndarray, at: np.ndarray, parts: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Products and examples of these blocks, where they are positive."""
        slot = np.full(self.blocks, -1)
        slot[blocks] = np.arange(len(blocks))
        own = slot[at // self.block]
        inside = own >= 0
        scores = np.bincount(own[inside] * self.block + at[inside] % self.block, parts[inside], len(blocks) * self.block)
        hit = np.flatnonzero(scores > 0)
        example = self.order[blocks[hit // self.block] * self.block + hit % self.block]
        return scores[hit][example != without], example[example != without]

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest positive dot products: (product, example).

        Bounds and products add up in the same order, so a bound is never below
        a product of its block, not even by rounding."""
        i, n = spread(self._best_starts[features], self._best_starts[features + 1])
        bounds = np.bincount(self._entered[i], np.repeat(weights, n) * self._best[i], self.blocks)
        i, n = spread(self._starts[features], self._starts[features + 1])
        at, parts = self._at[i], np.repeat(weights, n) * self._weight[i]
        todo = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds > 0)]
        product, example = np.zeros(0), np.zeros(0, np.int64)
        for blocks in (todo[:FIRST_BLOCKS], todo[FIRST_BLOCKS:]):
            if len(product) == k:
                blocks = blocks[bounds[blocks] > product[-1]]
            if not len(blocks):
                break
            product, example = map(np.concatenate, zip((product, example), self._scored(blocks, at, parts, without)))
            if len(product) > k:
                near = product >= np.partition(product, len(product) - k)[-k]
                product, example = product[near], example[near]
            first = np.lexsort((example, -product))[:k]
            product, example = product[first], example[first]
        return list(zip(product.tolist(), example.tolist()))


@dataclass
class Model:
    """What the tasks need; its size is bound by the texts of MAX_EXAMPLES examples."""

    features: list[str]
    idf: np.ndarray
    index: BlockMaxIndex | None
    ids: list[int]
    labels: np.ndarray
    rate: float
    raw: np.ndarray
    share: np.ndarray
    k: int = NEIGHBOURS

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        features = np.array([f for f, _ in counts], np.int64)
        weights = np.array([1 + math.log(n) for _, n in counts]) * self.idf[features]
        return features, weights / math.sqrt(float(np.sum(weights * weights)))

    def vote(self, counts, without: int = -1) -> tuple[float, list[int]]:
        """Distance-weighted vote, one vote's weight of it prior, and the voters."""
        if not counts or self.index is None:
            return self.rate, []
        found = self.index.nearest(*self.vector(counts), self.k, without)
        weight = sum(s for s, _ in found)
        for_it = sum(s for s, e in found if self.labels[e])
        return (for_it + self.rate) / (weight + 1), [e for _, e in found]

    def score(self, counts) -> tuple[float, list[int]]:
        raw, voters = self.vote(counts)
        return float(np.interp(raw, self.raw, self.share)), [self.ids[e] for e in voters]


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of neighbouring raw values whose shares of label 1 rise: their mean
    raw value and share, half a case of each label added."""
    pools: list[list[float]] = []  # raw sum, cases, positives
    for value in np.unique(raw):
        own = labels[raw == value]
        pools.append([value * len(own), len(own), float(own.sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    share = [(p + 0.5) / (n + 1) for _, n, p in pools]
    return np.array([s / n for s, n, _ in pools]), np.maximum.accumulate(share)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Model:
    """Learns from the labelled rows that are not held out."""
    examples = staged(examples_of(documents, labels, label, min(max_examples, MAX_EXAMPLES)))
    features = chosen_features(examples)
    rows = sorted(with_counts(examples, features, "counts").collect(), key=lambda r: (r.doc_id, r.label, r.counts))  # at most max_examples short rows
    y = np.array([r.label for r in rows], np.int64)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    model = Model(features, np.zeros(len(features)), None, [], y, rate, np.array([0.0, 1.0]), np.array([rate, rate]))
    if not features:
        return model
    n, frequency = document_frequencies(documents, features)
    model.idf = np.log((1 + n) / (1 + frequency)) + 1
    counts = [[(p.feature, p.n) for p in r.counts] for r in rows]
    with_any = [i for i, c in enumerate(counts) if c]
    model.ids, model.labels = [rows[i].doc_id for i in with_any], y[with_any]
    model.index = BlockMaxIndex([model.vector(counts[i]) for i in with_any], len(features))
    number = {i: e for e, i in enumerate(with_any)}
    raw = np.array([model.vote(c, number.get(i, -1))[0] for i, c in enumerate(counts)])
    model.raw, model.share = isotonic(raw, y)
    return model


def score(documents: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``documents`` with ``score`` (0 to 1), ``predicted`` (1 from THRESHOLD on) and
    ``neighbours``, the ids of the examples that voted, the nearest first.

    Columns of these names are replaced.  Only the text makes a score.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        own, vectors = sent.value, Vectors(sent.value.features)
        known = Bounded(own.score, 20_000)
        return lambda texts: (known[vectors.counts(t)] for t in texts)

    scored = map_texts(documents, column, make, {"score": ("double", pa.float64()), "neighbours": ("array<long>", pa.list_(pa.int64()))}, drop=["predicted"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every text.  Null and empty texts get the score of a text without any
    known term; rows of equal texts get equal scores; other columns are left out."""
    docs = documents.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns."""
    own = {name: unused(documents, name) for name in documents.columns if name in ("score", "predicted", "neighbours")}
    renamed = documents.withColumnsRenamed(own)
    kept = score(renamed, fit(documents, labels)).filter("predicted = 0").select(*(F.col(f"`{c}`") for c in renamed.columns))
    return kept.withColumnsRenamed({new: old for old, new in own.items()})
