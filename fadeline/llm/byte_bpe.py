"""Byte-level BPE: encoding with a queue of ranks, and decoding.

A text is cut by the vocabulary's pattern; each cut piece is merged on its own.
Words come back again and again, so a Python worker remembers the ids of the
words and pieces it has met, in dictionaries of bounded size; the new pieces of a
batch go through the queue together.

The queue has a bucket for each merge rank that holds positions in a linked list
of parts.  A bitmap of three levels, 64 bits a word, says which buckets are not
empty: the lowest rank is three find-first-set steps away, whatever the number of
parts.  Merging a pair changes the ranks of its neighbours; their old entries
stay where they are and are skipped when they come up.  A piece of n bytes thus
costs about n queue steps and not n squared, which matters for pieces of many
thousand bytes.  Pieces in one list do not touch: a gap between them has no rank.

Equal ranks are taken from left to right, as the usual rank files want it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fadeline.llm.text import map_texts

#: Words and pieces whose ids a worker remembers, each; longer ones are not kept.
REMEMBERED, SHORT = 350_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def first_set(word: int) -> int:
    return (word & -word).bit_length() - 1


class RankQueue:
    """Buckets of positions per rank below 2**18, the lowest rank first."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self._low, self._middle, self._top = [0] * 4096, [0] * 64, 0

    def put(self, rank: int, positions: list[int]) -> None:
        """Fill an empty bucket."""
        self.buckets[rank] = positions
        self._low[rank >> 6] |= 1 << (rank & 63)
        self._middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self._top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with all its positions from left to right; None at the end."""
        if not self._top:
            return None
        middle = first_set(self._top)
        low = middle << 6 | first_set(self._middle[middle])
        rank = low << 6 | first_set(self._low[low])
        positions = self.buckets.pop(rank)
        self._low[low] &= self._low[low] - 1
        if not self._low[low]:
            self._middle[middle] &= self._middle[middle] - 1
            if not self._middle[middle]:
                self._top &= self._top - 1
        positions.sort()
        return rank, positions


class Encoder:
    """Ids of texts.  ``ranks`` must hold every single byte; ids are below 2**18.

    ``by_word``: the pattern always cuts before a single space between two other
    characters, and what it cuts from there on to the next such space depends on
    nothing else.  This is so for the usual patterns, which put one space in front
    of a word; each such word is then looked up at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_word: bool = True):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"bytes without a rank: {lacking}")
        self._ranks, self._by_word = ranks, by_word
        single = [ranks[bytes([b])] for b in range(256)]
        self._cut = regex.compile(pattern).findall
        #: Rank of two neighbouring tokens as one, by both ids; as many as the tokens have ways to be cut in two.
        self._merged = {
            ranks[token[:k]] << 18 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self._single = np.array([*single, -1])
        self._pairs = np.array([self._merged.get(a << 18 | b, -1) if a >= 0 and b >= 0 else -1 for a in single + [-1] for b in single + [-1]])
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes | None] = {}
        self._long: list[str] = []
        self._queue = RankQueue()

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        merged, queue = self._merged.get, self._queue
        # one list of parts: the bytes of all pieces, with a gap before, between and after
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gaps = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(gaps[-1]) + 1
        parts = np.full(n, 256, np.int64)
        inside = np.ones(n, bool)
        inside[gaps] = False
        parts[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ranks = self._pairs[parts[:-1] * 257 + parts[1:]]  # of the pair that begins here
        starts = np.flatnonzero(ranks >= 0)
        starts = starts[np.argsort(ranks[starts], kind="stable")]
        found, first = np.unique(ranks[starts], return_index=True)
        for rank, positions in zip(found.tolist(), np.split(starts, first[1:])):
            queue.put(rank, positions.tolist())
        ids, rank_at = self._single[parts].tolist(), [*ranks.tolist(), -1]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        buckets, put = queue.buckets, queue.put
        while entry := queue.pop():
            rank, positions = entry
            lower = False
            for k, left in enumerate(positions):
                if rank_at[left] != rank:
                    continue  # stale
                gone = after[left]
                right = after[left] = after[gone]
                before[right] = left
                ids[left] = rank
                ids[gone] = rank_at[gone] = -2
                other = ids[right]
                new = rank_at[left] = merged(rank << 18 | other, -1) if other >= 0 else -1
                if new >= 0:
                    lower |= new < rank
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        put(new, [left])
                previous = before[left]
                other = ids[previous]
                new = rank_at[previous] = merged(other << 18 | rank, -1) if other >= 0 else -1
                if new >= 0:
                    lower |= new < rank
                    if new in buckets:
                        buckets[new].append(previous)
                    else:
                        put(new, [previous])
                if lower and k + 1 < len(positions):
                    put(rank, positions[k + 1 :])  # a lower rank has come up and goes first
                    break
        out, own = [], []
        for i in ids[1:]:
            if i >= 0:
                own.append(i)
            elif i == -1:
                out.append(own)
                own = []
        return out

    def _know(self, pieces: set[str]) -> Callable[[str], bytes]:
        """A function that has the ids of ``pieces``."""
        if len(self._pieces) > REMEMBERED:
            self._pieces.clear()
        new = []
        for piece in sorted(pieces - self._pieces.keys()):
            data = piece.encode("utf-8", "surrogatepass")
            whole = self._ranks.get(data)
            if len(piece) > SHORT:
                self._long.append(piece)
            if whole is None:
                new.append((piece, data))
            else:
                self._pieces[piece] = struct.pack("<I", whole)
        for (piece, _), ids in zip(new, self.merge([data for _, data in new])):
            self._pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return self._pieces.__getitem__

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty."""
        texts = [text or "" for text in texts]
        split = [text.split(" ") if self._by_word else [text] for text in texts]
        if len(self._words) > REMEMBERED:
            self._words.clear()
        new = set().union(*(own[1:] for own in split)) - self._words.keys()
        odd = [word for word in new if not word or word[0].isspace() or word[-1].isspace()]
        new.difference_update(odd)
        cuts = {word: self._cut(" " + word) for word in new}
        heads = [self._cut(own[0]) for own in split]
        known = self._know(set().union(*cuts.values(), *heads))
        self._words.update(dict.fromkeys(odd))
        self._words.update((word, b"".join(map(known, cut))) for word, cut in cuts.items())
        out = [self._by_words(own, map(known, head)) for own, head in zip(split, heads)]
        left = {i: self._cut(texts[i]) for i, ids in enumerate(out) if ids is None}
        known = self._know(set().union(*left.values()))
        for i, pieces in left.items():
            out[i] = b"".join(map(known, pieces))
        for word in [w for w in new if len(w) > SHORT]:
            del self._words[word]
        for piece in [p for p in self._long if p in self._pieces]:
            del self._pieces[piece]
        self._long.clear()
        return out

    def _by_words(self, own: list[str], head: Iterable[bytes]) -> bytes | None:
        """Ids of a text from its parts at single spaces; None if one of these lies beside other white space."""
        if len(own) > 1 and (not own[0] or own[0][-1].isspace()):
            return None
        try:
            return b"".join([*head, *map(self._words.__getitem__, own[1:])])
        except TypeError:  # a part without ids of its own
            return None


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self._tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._tokens[rank] = token

    def ids(self, ids: bytes | None) -> bytes:
        return b"".join(map(self._tokens.__getitem__, memoryview(ids or b"").cast("I")))


#: The coder a Python worker made last: its tables serve all tasks of that worker.
_made: dict[str, tuple] = {}


def _once(kind: str, key: tuple, make: Callable):
    """``key`` is compared by value, so equal tables sent anew are not built again."""
    if kind not in _made or _made[kind][0] != key:
        _made[kind] = (key, make())
    return _made[kind][1]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``into``, the ids of ``column`` as little-endian 32-bit integers,
    and with ``decoded``, if asked for, the bytes that these ids stand for: a check
    of the round trip without a second pass.

    A null text counts as empty and has no ids.  Columns named as ``into`` are
    replaced, all others are kept.  The ranks go to the executors as a broadcast:
    their number is that of the vocabulary.
    """
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder = _once("encoder", (len(sent.value), hash(frozenset(sent.value.items())), pattern), lambda: Encoder(sent.value, pattern))
        if not decoded:
            return lambda texts: ((ids,) for ids in encoder.texts(texts))
        decoder = Decoder(sent.value)
        return lambda texts: ((ids, decoder.ids(ids)) for ids in encoder.texts(texts))

    return map_texts(df, column, make, {name: ("binary", pa.binary()) for name in (into, decoded) if name})


def decode(df: DataFrame, ranks: dict[bytes, int], column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with ``into``, the bytes that the ids in ``column`` stand for; none for null."""
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        decoder = _once("decoder", (len(sent.value), hash(frozenset(sent.value.items()))), lambda: Decoder(sent.value))
        return lambda values: ((decoder.ids(v),) for v in values)

    return map_texts(df, column, make, {into: ("binary", pa.binary())})


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row the number of ids and the digests of ids and decoded bytes."""
    return encode(df.select("doc_id", "text"), ranks, pattern, decoded="decoded").select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
