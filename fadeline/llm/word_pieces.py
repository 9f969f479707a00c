"""Token counts by greedy longest match, without building the pieces.

A word is covered from left to right by the longest vocabulary entry that fits:
one that opens a word first, then ones that go on.  Both kinds stand in one trie,
the second below a root of its own.  Each node has a failure link, where the match
goes on when no child fits, and the number of pieces that are finished on the way
there.  Both are worked out once when the automaton is made, so counting reads
each character once and adds numbers; it never goes back in the word.

A word that the vocabulary cannot cover counts as one unknown token.  White space
parts words and is no token.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from fadeline.llm.text import LONGEST_KNOWN, Bounded, map_texts, words

#: Distinct words whose count a task remembers.
REMEMBERED = 500_000

#: An unknown word: one token, and one in the upper half that counts such words.
UNKNOWN = 1 << 32 | 1

#: Fixed values of the tokenizer format: the mark of a word's beginning.
OPENS = "▁"


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """The entries of a piece model that open a word, and those that go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    opening = sorted({p[1:] for p in pieces if p.startswith(OPENS) and len(p) > 1 and OPENS not in p[1:]})
    return opening, sorted({p for p in pieces if OPENS not in p})


class Automaton:
    """Nodes are numbers: 0 where a word begins, 1 where it goes on after a piece."""

    def __init__(self, opening: Iterable[str], going_on: Iterable[str]):
        self._child: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((0, opening), (1, going_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 21 | ord(c)
                    if key not in self._child:
                        self._child[key] = len(ends)
                        ends.append(False)
                    node = self._child[key]
                ends[node] |= node > 1
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self._child.items():
            below[key >> 21].append((key & 0x1FFFFF, node))
        #: Where to go when no child fits (-1: the word can't be covered), and the pieces finished by then.
        self._fail, self._popped = [-1] * len(ends), [0] * len(ends)
        todo = deque([0, 1])
        while todo:
            parent = todo.popleft()
            for c, node in below[parent]:
                todo.append(node)
                if ends[node]:
                    self._fail[node], self._popped[node] = 1, 1
                    continue
                at, popped = self._fail[parent], self._popped[parent]
                while at >= 0 and (at << 21 | c) not in self._child:
                    popped += self._popped[at]
                    at = self._fail[at]
                if at >= 0:
                    self._fail[node], self._popped[node] = self._child[at << 21 | c], popped

    def count(self, word: str) -> int:
        """Number of pieces, or UNKNOWN."""
        child, fail, popped = self._child, self._fail, self._popped
        node = count = 0
        for c in map(ord, word):
            while (node << 21 | c) not in child:
                if fail[node] < 0:
                    return UNKNOWN
                count += popped[node]
                node = fail[node]
            node = child[node << 21 | c]
        while node > 1:
            if fail[node] < 0:
                return UNKNOWN
            count += popped[node]
            node = fail[node]
        return count


_made: dict[str, tuple] = {}


def token_counts(df: DataFrame, opening: list[str], going_on: list[str], column: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` and ``n_unknown`` of ``column``.

    An empty or null text has none of them.  Columns of these names are replaced,
    all others are kept.  The vocabulary goes to the executors as a broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast((opening, going_on))

    def make():
        if _made.get("key") != sent.value:
            automaton = Automaton(*sent.value)
            _made.update(key=sent.value, counts=Bounded(lambda w: automaton.count(w.decode("utf-8", "surrogatepass")), REMEMBERED, LONGEST_KNOWN))
        known = _made["counts"].__getitem__

        def rows(texts):
            for text in texts:
                own = words(text or "")
                total = sum(map(known, own))
                yield len(own), total & 0xFFFFFFFF, total >> 32

        return rows

    return map_texts(df, column, make, {n: ("long", pa.int64()) for n in ("n_words", "n_tokens", "n_unknown")})
